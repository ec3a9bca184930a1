"""Scalar operators as SQL expressions of a dialect and an expression: text, patterns, dates, numbers, predicates.

Each takes a Dialect and SQL expressions and returns one; ``writlake.functions.columns`` wraps them as Spark Columns.
"""

from __future__ import annotations

from writlake.functions import lexicons as L
from writlake.functions.dialect import Dialect

ARABIC = "؀-ۿ"
YEAR, MONTH, DAY = "((?:20|19)[0-9]{2})", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
SEP = "[/.-]"
BLANK = " \t\n\x0b\x0c\r"
LEFT, RIGHT = "(?:^|[^0-9])", "(?:[^0-9]|$)"


# Text

def digits(d: Dialect, x: str) -> str:
    return d.translate(x, L.ARABIC_DIGITS + L.EXTENDED_DIGITS, L.ASCII_DIGITS * 2)


def fold_alef(d: Dialect, x: str) -> str:
    return d.translate(x, L.ALEF_FROM, L.ALEF_TO)


def fold_separators(d: Dialect, x: str) -> str:
    return d.translate(x, L.SEPARATORS_FROM, L.SEPARATORS_TO)


def strip_garbage(d: Dialect, x: str) -> str:
    """A bar becomes a line break, other noise goes."""
    return d.translate(x, "|" + L.GARBAGE, "\n")


def trim(d: Dialect, x: str) -> str:
    return f"{'btrim' if d.spark else 'trim'}({x}, {d.text(BLANK)})"


def squeeze(d: Dialect, x: str) -> str:
    bare = d.replace(x, r"\s+", " ")
    return f"trim({bare})" if d.spark else trim(d, bare)  # only spaces are left


def lines(d: Dialect, x: str) -> str:
    """Trimmed lines that are not empty, with runs of spaces and tabs squeezed."""
    if d.spark:  # squeezed at once, so that only spaces are left to trim
        parts = d.map(d.split(d.replace(x, r"[ \t]+", " "), r"\r\n|[\n\r\x0B\x0C]"), "v", "trim(v)")
    else:
        parts = d.map(d.split(x, r"\r\n|[\n\r\x0B\x0C]"), "v", trim(d, d.replace("v", r"[ \t]+", " ")))
    return d.filter(parts, "v", "v <> ''")


def collapse(d: Dialect, x: str) -> str:
    if d.spark:  # the joined lines without an array of them
        return f"btrim({d.replace(d.replace(x, r'[ \t]+', ' '), r' ?[\n\r\x0B\x0C][ \n\r\x0B\x0C]*', chr(10))}, {d.text(' ' + chr(10))})"
    return d.join(lines(d, x), "\n")


def normalize(d: Dialect, x: str) -> str:
    """The cleaned text that extraction works on; null is empty."""
    x = f"coalesce({x}, '')"
    return collapse(d, d.translate(x, *folds()) if d.spark else strip_garbage(d, fold_separators(d, fold_alef(d, digits(d, x)))))


def folds() -> tuple[str, str]:
    """The four translations one after the other as one; what has no counterpart goes."""
    steps = ((L.ARABIC_DIGITS + L.EXTENDED_DIGITS, L.ASCII_DIGITS * 2), (L.ALEF_FROM, L.ALEF_TO), (L.SEPARATORS_FROM, L.SEPARATORS_TO), ("|" + L.GARBAGE, "\n"))
    kept, gone = {}, []
    for first in dict.fromkeys("".join(old for old, _ in steps)):
        c = first
        for old, new in steps:
            c = new[old.index(c)] if c and c in old and old.index(c) < len(new) else "" if c and c in old else c
        if c:
            kept[first] = c
        else:
            gone.append(first)
    return "".join(kept) + "".join(gone), "".join(kept.values())


def clean_value(d: Dialect, x: str) -> str:
    return d.nonempty(trim(d, d.replace(squeeze(d, x), "^[:：–— -]+", "")))


def review_value(d: Dialect, x: str) -> str:
    """For comparing reviews: digits, diacritics, spaces and spaced hyphens don't count; empty is null."""
    bare = d.replace(digits(d, x), "[ً-ٰٟۖ-ۭ]", "")
    return d.nonempty(squeeze(d, d.replace(bare, r"\s*-\s*", "-")))


def review_date(d: Dialect, x: str) -> str:
    """YYYY-MM-DD from either order, or the compared value."""
    return d.let(trim(d, digits(d, x)), lambda t: _review_date(d, t))


def _review_date(d: Dialect, t: str) -> str:
    p = d.split(t, "[/-]")
    a, b, c = (d.at(p, str(i)) for i in (1, 2, 3))
    y, z = f"case when length({a}) = 4 then {a} else {c} end", f"case when length({a}) = 4 then {c} else {a} end"
    number = lambda v: f"cast({d.int(v)} as string)" if d.spark else f"cast({d.int(v)} as varchar)"
    date = f"concat({d.pad(number(y), 4)}, '-', {d.pad(number(b), 2)}, '-', {d.pad(number(z), 2)})"
    ok = f"{d.size(p)} = 3 and (length({a}) = 4 or length({c}) = 4) and {d.int(y)} is not null and {d.int(b)} is not null and {d.int(z)} is not null"
    return f"case when {t} is null then null when {ok} then {date} else {review_value(d, t)} end"


def cut_stop_phrases(d: Dialect, x: str) -> str:
    """Cut before each stop phrase in the list's order, each on what the one before left."""
    for phrase in L.STOP_PHRASES:
        x = d.before(x, phrase)
    return x


def fix_word(d: Dialect, x: str) -> str:
    return f"case {x} " + " ".join(f"when {d.text(a)} then {d.text(b)}" for a, b in L.WORD_FIXES.items()) + f" else {x} end"


def arabic_words(d: Dialect, x: str) -> str:
    return d.extract_all(x, f"[{ARABIC}]{{2,}}")


def clean_words(d: Dialect, words: str) -> str:
    """Misread words mended, noise dropped."""
    return d.filter(d.map(words, "w", fix_word(d, "w")), "w", f"not {d.among('w', L.NAME_NOISE)}")


# Patterns and numbers

def any_phrase(d: Dialect, x: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(d.contains(x, d.text(p)) for p in phrases) + ")"


def national_ids(d: Dialect, x: str) -> str:
    """Digit runs of 10 or 11."""
    return d.filter(d.extract_all(x, "[0-9]+"), "v", "length(v) in (10, 11)")


def is_company(d: Dialect, x: str) -> str:
    return any_phrase(d, x, L.COMPANY_KEYWORDS)


def is_recipient(d: Dialect, x: str) -> str:
    """A greeting or an address, unless it holds an id or a registration number."""
    return f"({any_phrase(d, x, L.RECIPIENTS)} and {d.size(national_ids(d, x))} = 0 and {registration(d, x)} is null)"


def valid_name(d: Dialect, name: str, short_ok: str) -> str:
    """No word of a label or of legal text, and three words at least unless ``short_ok``."""
    words = d.split(name, r"\s+")
    return f"({name} is not null and {name} <> '' and not {d.any_among(words, tuple(dict.fromkeys(L.LABEL_NOISE + L.INVALID_NAME_WORDS)))} and ({d.size(words)} >= 3 or {short_ok}))"


def registration_shape(d: Dialect, x: str) -> str:
    value = d.replace(f"upper({d.replace(d.replace(trim(d, x), '[ ]*[–—-][ ]*', '-'), r'\s+', '')})", "^RE6-", "REG-")
    return d.let(value, lambda v: f"case when {d.matches(v, '^([A-Z]{1,10}-)?[0-9]{3,15}$')} then {v} end")


def registration(d: Dialect, x: str) -> str:
    """A registration number beside its label; the first pattern that matches decides."""
    value = r"([A-Za-z]{1,10}\s*[–—-]\s*[0-9]{3,15}|[0-9]{3,15})"
    after, before = d.extract(x, rf"{L.REGISTRATION_LABELS}\s*[:：]?\s*{value}", 1), d.extract(x, rf"{value}\s*[:：]?\s*{L.REGISTRATION_LABELS}", 1)
    return registration_shape(d, f"coalesce({after}, {before})")


def case_number(d: Dialect, x: str) -> str:
    """Slash or hyphen pair as it stands, number and year apart by spaces, or year and number in one (not a date)."""
    return d.let(squeeze(d, x), lambda v: _case_number(d, v))


def _case_number(d: Dialect, v: str) -> str:
    direct = d.extract(v, r"(?:^|[^0-9/])([0-9]{1,6}\s*[/-]\s*[0-9]{1,6})(?:[^0-9/]|$)", 1)
    direct = d.translate(d.replace(direct, r"\s+", ""), "-", "/")
    year = "(20[0-9]{2}|19[0-9]{2})"
    one = rf"{LEFT}([0-9]{{1,6}})\s+{year}{RIGHT}"
    two = rf"{LEFT}{year}\s+([0-9]{{1,6}}){RIGHT}"
    joined = d.extract(v, rf"{LEFT}(?:20|19)([0-9]{{3,6}}){RIGHT}", 0)
    run = d.extract(joined, "[0-9]+", 0)
    halves = lambda r: f"case when length({r}) <> 8 then concat(substr({r}, 1, 4), '/', substr({r}, 5)) end"
    compact = d.let(run, halves) if d.spark else halves(run)
    pair = lambda p, a, b: f"{d.extract(v, p, a)} || '/' || {d.extract(v, p, b)}"
    return f"coalesce({direct}, {pair(one, 1, 2)}, {pair(two, 2, 1)}, {compact})"


def document_number(d: Dialect, x: str) -> str:
    """LETTERS-YYYY-NNNN; a prefix with digits or bars is the fixed one, misread."""
    value = f"upper({d.replace(d.replace(trim(d, x), r'\s*[–—-]\s*', '-'), r'\s+', '')})"
    tail = lambda v: d.extract(v, "^[A-Z0-9|/]{1,10}-([0-9]{4}-[0-9]{3,10})$", 1)
    return d.let(value, lambda v: f"case when {d.matches(v, '^[A-Z]{1,10}-[0-9]{4}-[0-9]{3,10}$')} then {v} when {tail(v)} is not null then concat('UW-', {tail(v)}) end")


def close_separators(d: Dialect, x: str) -> str:
    """No spaces around separators between digits; twice each, as matches overlap."""
    for _ in range(2):
        x = d.replace(x, r"([0-9])\s+([/.-]\s*[0-9])", "$1$2")
    for _ in range(2):
        x = d.replace(x, r"([0-9][/.-])\s+([0-9])", "$1$2")
    return x


def first_date(d: Dialect, x: str) -> str:
    """YYYY/MM/DD of the first date by form: year first, day first, then compact; the calendar is not asked."""
    return d.let(close_separators(d, x), lambda t: _first_date(d, t))


def _first_date(d: Dialect, t: str) -> str:
    def date(pattern: str, y: int, m: int, day: int) -> str:
        part = lambda x, g, n: d.let(d.extract(x, pattern, g), lambda v: d.pad(v, n)) if d.spark else d.pad(d.extract(x, pattern, g), n)
        # The parts are read from the match alone.
        return d.let(d.extract(t, pattern, 0), lambda x: f"case when {x} is not null then {part(x, y, 4)} || '/' || {part(x, m, 2)} || '/' || {part(x, day, 2)} end")

    ymd, dmy = f"{LEFT}{YEAR}{SEP}{MONTH}{SEP}{DAY}{RIGHT}", f"{LEFT}{DAY}{SEP}{MONTH}{SEP}{YEAR}{RIGHT}"
    compact = f"{LEFT}{YEAR}{SEP}?(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01]){RIGHT}"
    short = f"{LEFT}{YEAR}{SEP}([1-9])(0[1-9]|[12][0-9]|3[01]){RIGHT}"
    return f"coalesce({date(ymd, 1, 2, 3)}, {date(dmy, 3, 2, 1)}, {date(compact, 1, 2, 3)}, {date(short, 1, 2, 3)})"


BOOK = r"([A-Za-z0-9|/\s]{1,6}[–—-]\s*[0-9]{4}\s*[–—-]\s*[0-9]{3,10})"
BOOK_AFTER = rf"(?i){L.BOOK_LABELS}\s*[:：.]?\s*(?:[0-9]\s+)?{BOOK}"
BOOK_BEFORE = rf"(?i){BOOK}\s*[:：.]?\s*{L.BOOK_LABELS}"


def first_date_outside_numbers(d: Dialect, x: str) -> str:
    """The first date once document numbers are blanked, whose tails look like dates."""
    for pattern in (BOOK_AFTER, BOOK_BEFORE, r"[A-Za-z0-9|]{1,10}\s*[–—-]\s*[0-9]{4}\s*[–—-]\s*[0-9]{3,10}"):
        x = d.replace(x, pattern, " ")
    return first_date(d, x)


# Predicates and scores

def id_status(d: Dialect, x: str) -> str:
    return f"case when {x} is null then 'missing' when {d.matches(x, '^[0-9]{11}$')} then 'valid' when {d.matches(x, '^[0-9]{10}$')} then 'plausible' else 'invalid' end"


def confidence_label(d: Dialect, x: str) -> str:
    return f"case when {x} >= {L.EXACT} then 'High' when {x} >= {L.REVIEW_BELOW} then 'Medium' else 'Needs Review' end"


def ocr_quality(d: Dialect, x: str, confidence: str) -> str:
    """Arabic share, legal keywords, lines and the engine's confidence; halved for under 20 characters, 0 for blank text."""
    return d.let(trim(d, f"coalesce({x}, '')"), lambda t: _ocr_quality(d, t, confidence))


def _ocr_quality(d: Dialect, t: str, confidence: str) -> str:
    letters = f"length({d.replace(t, f'[^{ARABIC}]', '')})"
    words = " + ".join(f"case when {d.contains(t, d.text(k))} then 1 else 0 end" for k in L.LEGAL_KEYWORDS)
    total = f"length({t})"
    rows = f"least({d.size(lines(d, t))} / 10.0D, 1.0D)" if d.spark else f"least({d.size(lines(d, t))} / 10.0::double, 1.0::double)"
    double = (lambda v: f"cast({v} as double)")
    score = f"(0.35 * {double(letters)} / {double(total)} + 0.30 * ({words}) / {double(str(len(L.LEGAL_KEYWORDS)))} + 0.15 * {rows} + 0.20 * greatest(0.0, least({double(f'coalesce({confidence}, 0)')}, 1.0)))"
    return f"case when {t} = '' then 0.0 else round(cast(greatest(0.0, least(case when {total} < 20 then {score} * 0.5 else {score} end, 1.0)) as double), 3) end"
