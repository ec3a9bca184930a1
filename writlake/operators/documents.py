"""Document fields from lines: court, case number, document number, date, with confidence and review flags."""

from __future__ import annotations

from writlake.functions import expressions as E
from writlake.functions import lexicons as L
from writlake.functions.dialect import Dialect

COURT = f"محكمة\\s+[{E.ARABIC}]{{2,20}}(?:\\s+[{E.ARABIC}]{{2,20}}){{0,4}}"
PAIR = r"([0-9]{1,6}\s*[/\s]\s*(?:20|19)[0-9]{2}|(?:20|19)[0-9]{2}\s*[/\s]\s*[0-9]{1,6})"
CASE_AFTER = rf"{L.CASE_LABELS}\s*[:：.]?\s*(?:[0-9]\s+)?{PAIR}"
CASE_BEFORE = rf"{PAIR}\s*[:：.]?\s*{L.CASE_LABELS}"


def field(d: Dialect, value: str, confidence: str, review: str) -> str:
    """A field; without a value it has no confidence and is to be reviewed."""
    some = f"({value} is not null)"
    return d.struct(value=value, confidence=f"cast(case when {some} then {confidence} else 0.0 end as double)", needs_review=f"case when {some} then {review} else true end")


def first_of(d: Dialect, *ways: tuple[str, dict[str, str]]) -> str:
    """The first way with a value, with its other columns; later ways are not computed."""
    return "coalesce(" + ", ".join(d.let(value, lambda v, more=more: f"case when {v} is not null then {d.struct(value=v, **more)} end") for value, more in ways) + ")"


def value_after(d: Dialect, line: str, phrase: str) -> str:
    """What follows a phrase on a line; after a colon or a full stop if there is one."""
    rest = E.trim(d, f"substr({line}, strpos({line}, {d.text(phrase)}) + {len(phrase)})") if not d.spark else E.trim(d, f"substr({line}, instr({line}, {d.text(phrase)}) + {len(phrase)})")
    return E.clean_value(d, f"coalesce({d.extract(rest, r'[:：.]\s*(.+)$', 1)}, {rest})")


def case_number(d: Dialect, lines: str) -> str:
    """value and way (strong, keyword, scan); the first line with a label decides, even if it has no number."""
    return d.let(lines, lambda x: _case_number(d, x))


def _case_number(d: Dialect, lines: str) -> str:
    full = d.join(lines, "\n")
    strong = d.let(full, lambda t: f"coalesce({E.case_number(d, d.extract(t, CASE_AFTER, 1))}, {E.case_number(d, d.extract(t, CASE_BEFORE, 1))})")
    place = d.first_place(lines, "v", E.any_phrase(d, "v", L.CASE_NUMBER_KEYWORDS))
    line = d.at(lines, f"greatest({place}, 1)")
    after = d.let(line, lambda v: "case " + " ".join(f"when {d.contains(v, d.text(k))} then coalesce({value_after(d, v, k)}, {v})" for k in L.CASE_NUMBER_KEYWORDS) + " end")
    labelled = f"case when {place} > 0 then coalesce({E.case_number(d, after)}, {E.case_number(d, d.at(lines, f'{place} + 1'))}) end"
    free = d.filter(lines, "v", f"not {E.any_phrase(d, 'v', (*L.DOCUMENT_NUMBER_KEYWORDS, 'الكتاب'))} and {E.first_date(d, 'v')} is null and {E.case_number(d, 'v')} is not null")
    scan = f"case when {place} = 0 then {E.case_number(d, d.at(free, '1'))} end"
    return first_of(d, (strong, {"way": "'strong'"}), (labelled, {"way": "'keyword'"}), (scan, {"way": "'scan'"}))


def document_number(d: Dialect, lines: str) -> str:
    """From the first 25 lines, else from all."""
    def search(text: str) -> str:
        return d.let(text, lambda t: f"coalesce({E.document_number(d, d.extract(t, E.BOOK_AFTER, 1))}, {E.document_number(d, d.extract(t, E.BOOK_BEFORE, 1))})")

    return f"coalesce({search(d.join(d.slice(lines, '1', '25'), chr(10)))}, {search(d.join(lines, chr(10)))})"


def labelled_date(d: Dialect, lines: str) -> str:
    """Around the first line with a date label (previous, same and next line)."""
    return d.let(lines, lambda x: _labelled_date(d, x))


def _labelled_date(d: Dialect, lines: str) -> str:
    place = d.first_place(lines, "v", E.any_phrase(d, "v", L.DATE_KEYWORDS))
    around = f"concat_ws(' ', {d.at(lines, f'nullif({place}, 1) - 1')}, {d.at(lines, place)}, {d.at(lines, f'{place} + 1')})"
    return f"case when {place} > 0 then {E.first_date(d, around)} end"


def document_date(d: Dialect, header: str, text: str) -> str:
    """value and confidence: anywhere in the header, by a header label, anywhere in the text, by a label."""
    head, body = E.lines(d, header), E.lines(d, f"concat({header}, chr(10), {text})")
    ways = (("0.90", E.first_date_outside_numbers(d, header)), ("0.90", labelled_date(d, head)), ("0.85", E.first_date_outside_numbers(d, text)), ("0.90", labelled_date(d, body)))
    return first_of(d, *((v, {"confidence": f"cast({c} as double)"}) for c, v in ways))


def court_by_rule(d: Dialect, lines: str) -> str:
    """value and confidence: a court's name in the first 25 lines, over two joined lines, or a short line with a court word."""
    def fit(x: str) -> str:
        return d.filter(d.map(x, "v", E.squeeze(d, d.extract("v", COURT, 0))), "w", "w is not null and length(w) <= 60")

    single = d.at(fit(d.slice(lines, "1", "25")), "1")
    if d.spark:
        joined = f"transform(slice({lines}, 1, 25), (v, i) -> concat(v, ' ', get({lines}, i + 1)))"
    else:
        joined = f"list_transform(list_slice({lines}, 1, 25), lambda v, i: v || ' ' || list_extract({lines}, i + 1))"
    double = d.at(fit(joined), "1")
    short = d.at(d.filter(lines, "v", f"length(v) <= 60 and {E.any_phrase(d, 'v', L.COURT_NAME_KEYWORDS)}"), "1")
    return first_of(d, *((v, {"confidence": f"cast({c} as double)"}) for c, v in (("0.90", single), ("0.75", double), ("0.75", short))))


#: Words of the court list that are alike enough (a ratio of matching blocks of 0.72 or more) to stand for each other; tests derive them.
ALIKE = {"عمان": "معان", "معان": "عمان", "اربد": "إربد", "إربد": "اربد", "العدل": "العليا", "العليا": "العدل"}


def known_court(d: Dialect, text: str) -> str:
    """The listed court with the most words found among the first four of an 80-character window at some محكمة; then the earliest window, then the list's order.

    Words match if equal or alike; misread words that are not in the list are not matched yet.
    """
    if d.spark:  # the text and its parts are computed once
        return d.let(text, lambda t: d.let(d.split(t, "محكمة"), lambda p: _known_court(d, t, p)))
    return _known_court(d, text, d.split(text, "محكمة"))


def _known_court(d: Dialect, text: str, parts: str) -> str:
    offsets = f"transform(sequence(1, greatest(size({parts}) - 1, 1)), i -> length(array_join(slice({parts}, 1, i), 'محكمة')))" if d.spark else f"list_transform(range(1, greatest(len({parts}) - 1, 1) + 1), lambda i: length(coalesce(array_to_string(list_slice({parts}, 1, i), 'محكمة'), '')))"
    windows = d.map(offsets, "o", d.slice(E.arabic_words(d, f"substr({text}, cast(o as int) + 1, 80)"), "1", "4"))
    courts = sorted(range(len(L.COURTS)), key=lambda i: (-len(L.COURTS[i].split()), i))
    by_size: dict[int, list[str]] = {}
    for i in courts:
        by_size.setdefault(len(L.COURTS[i].split()), []).append(L.COURTS[i])

    def test(court: str) -> str:
        return "(" + " and ".join("(" + " or ".join(d.has("w", d.text(x)) for x in (word, ALIKE.get(word)) if x) + ")" for word in court.split()) + ")"

    out = []
    for names in by_size.values():
        which = "case " + " ".join(f"when {test(n)} then {d.text(n)}" for n in names) + " end"
        out.append(d.at(d.filter(d.map("ws", "w", which), "v", "v is not null"), "1"))
    name = "ws"
    body = f"coalesce({', '.join(out)})"
    bound = d.at(d.map(d.items(windows), name, body), "1")
    return f"case when {d.contains(text, d.text('محكمة'))} then {bound} end"


def validate_field(d: Dialect, name: str, field_: str) -> str:
    """A field without its shape loses its value; a weak one is to be reviewed."""
    shapes = {
        "case_number": "^([0-9]{1,6}/(19|20)[0-9]{2}|(19|20)[0-9]{2}/[0-9]{1,6})$",
        "document_number": "^[A-Z]{1,10}-(19|20)[0-9]{2}-[0-9]{2,10}$",
        "document_date": "^(19|20)[0-9]{2}/(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])$",
    }
    ok = f"({field_}.value is not null and {field_}.value <> ''" + (f" and {d.matches(f'{field_}.value', shapes[name])}" if name in shapes else "") + ")"
    return d.struct(value=f"case when {ok} then {field_}.value end", confidence=f"case when {ok} then {field_}.confidence else cast(0.0 as double) end", needs_review=f"case when {ok} then ({field_}.needs_review or {field_}.confidence < {L.REVIEW_BELOW}) else true end")
