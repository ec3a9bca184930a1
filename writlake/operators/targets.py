"""Persons beside the phrase rules: the list of target persons, names around ids, orphan first names, and their order-dependent folds.

Every operator is an expression on normalized text or on an array of records; a record has the fields of ``RECORD``.
"""

from __future__ import annotations

from writlake.functions import expressions as E
from writlake.functions import lexicons as L
from writlake.functions.dialect import Dialect
from writlake.operators import persons as P

RECORD = ("full_name", "national_id", "registration_number", "person_type", "confidence", "needs_review", "source", "extraction_method")
REGISTRATION = r"[A-Za-z0-9]{1,10}\s*[–—-]\s*[0-9]{3,15}"


def record(d: Dialect, method: str, name: str, national_id: str | None = None, registration: str | None = None, confidence: str = "0.90", review: str = "false") -> str:
    kind = "'Company'" if registration else "'Individual'"
    return d.struct(
        full_name=name, national_id=national_id or P.null(d), registration_number=registration or P.null(d), person_type=kind, confidence=f"cast({confidence} as double)",
        needs_review=review, source="'rules'", extraction_method=f"'{method}'",
    )


def some(d: Dialect, records: str) -> str:
    return d.filter(records, "s", "s is not null")


def lines_of(d: Dialect, text: str) -> str:
    return d.filter(d.split(text, "\n"), "v", "v <> ''")


def words_of(d: Dialect, x: str) -> str:
    return d.split(x, " ")


def tail(d: Dialect, words: str, n: int) -> str:
    """The last n words as a text."""
    return d.join(d.slice(words, d.integer(f"greatest({d.size(words)} - {n - 1}, 1)"), str(n)), " ")


def segments(d: Dialect, words: str, noise: tuple[str, ...]) -> str:
    """Runs of words between words of noise, each a text."""
    cut = d.join(d.map(words, "w", f"case when {d.among('w', noise)} then '|' else w end"), " ")
    return d.filter(d.map(d.split_on(cut, "|"), "v", E.trim(d, "v")), "v", "v <> ''")


def target_section(d: Dialect, text: str) -> str:
    """The lines from the heading of the target persons up to a section's end, as one line; empty without the heading."""
    places = [f"nullif({d.place(text, d.text(x))}, 0)" for x in L.TARGET_HEADINGS]
    start = f"least({', '.join(places)})"
    lines = f"case when {start} is not null then {lines_of(d, f'substr({text}, {d.integer(start)})')} end"

    def upto(x: str) -> str:
        end = d.first_place(x, "v", E.any_phrase(d, "v", L.SECTION_ENDS))
        return f"case when {x} is null then '' when {end} = 0 then {d.join(x, ' ')} else {d.join(d.slice(x, '1', d.integer(f'{end} - 1')), ' ')} end"

    return E.squeeze(d, d.let(lines, upto))


def plain_words(d: Dialect, x: str) -> str:
    """Arabic words with marks as blanks, misread words mended."""
    return d.map(E.arabic_words(d, d.translate(x, "|:：-،", "     ")), "w", E.fix_word(d, "w"))


NOISE = tuple(dict.fromkeys(L.LABEL_NOISE + L.INVALID_NAME_WORDS + L.NAME_NOISE))


def listed_name(d: Dialect, x: str) -> str:
    """The last run of three words or more (its last six), or null."""
    runs = d.filter(segments(d, plain_words(d, x), NOISE), "v", f"{d.size(words_of(d, 'v'))} >= 3")
    names = d.filter(d.map(runs, "v", tail(d, words_of(d, "v"), 6)), "n", E.valid_name(d, "n", "false"))
    return d.let(names, lambda n: d.at(n, f"nullif({d.size(n)}, 0)"))


def listed_company(d: Dialect, x: str) -> str:
    """The longest run (its last eight words) that holds a company's word; the first of equal ones, or null."""
    runs = segments(d, plain_words(d, x), tuple(w for w in NOISE if w != "شركة"))
    names = d.filter(d.map(d.filter(runs, "v", f"{d.size(words_of(d, 'v'))} >= 2"), "v", tail(d, words_of(d, "v"), 8)), "n", E.any_phrase(d, "n", L.COMPANY_KEYWORDS))

    def longest(n: str) -> str:
        sizes = d.map(n, "v", d.size(words_of(d, "v")))
        most = f"array_max({sizes})" if d.spark else f"list_max({sizes})"
        return d.at(d.filter(n, "v", f"{d.size(words_of(d, 'v'))} = {most}"), "1")

    return d.let(names, longest)


def around(d: Dialect, text: str, start: str, size: str, before: int, after: int) -> tuple[str, str]:
    """The characters before a place (from 1) and after what begins there."""
    low = f"greatest({start} - {before}, 1)"
    return f"substr({text}, {d.integer(low)}, {d.integer(f'{start} - {low}')})", f"substr({text}, {d.integer(f'{start} + {size}')}, {after})"


def listed_persons(d: Dialect, section: str) -> str:
    """A record for each id of the section in turn, each looked for behind the one before, with the name before it or after it."""
    walked = d.map(E.national_ids(d, section), "i", d.struct(id="i", at="0", next="1"))
    last = f"coalesce({d.at('acc', f'nullif({d.size('acc')}, 0)')}.next, 1)"
    found = d.place(f"substr({section}, {d.integer(last)})", "r.id")
    step = f"list_concat(acc, [{d.struct(id='r.id', at=f'case when {found} > 0 then {found} + {last} - 1 else 0 end', next=f'case when {found} > 0 then {found} + {last} - 1 + length(r.id) else {last} end')}])"
    if d.spark:
        step = f"concat(acc, array({d.struct(id='r.id', at=f'cast(case when {found} > 0 then {found} + {last} - 1 else 0 end as int)', next=f'cast(case when {found} > 0 then {found} + {last} - 1 + length(r.id) else {last} end as int)')}))"
    none = "cast(array() as array<struct<id:string,at:int,next:int>>)" if d.spark else f"list_slice({walked}, 1, 0)"
    places = d.filter(d.fold(walked, none, "acc", "r", step), "p", "p.at > 0")
    before, after = around(d, section, "p.at", "length(p.id)", 220, 180)
    named = d.let(f"coalesce({listed_name(d, before)}, {listed_name(d, after)})", lambda n: f"case when {n} is not null then {record(d, 'structured_target_list', n, 'p.id')} end")
    return some(d, d.map(places, "p", named))


def registrations(d: Dialect, section: str) -> str:
    """Distinct registration numbers: after a label, before one, then by their own shape."""
    value = rf"({REGISTRATION}|[0-9]{{3,15}})"
    ways = (rf"{L.REGISTRATION_LABELS}\s*[:：]?\s*{value}", rf"{value}\s*[:：]?\s*{L.REGISTRATION_LABELS}", r"(?i)(RE[G6]\s*[–—-]\s*[0-9]{3,15})")
    found = d.map(d.concat_arrays(*(d.extract_all(section, w, 1) for w in ways)), "v", E.registration_shape(d, "v"))
    return d.let(d.filter(found, "v", "v is not null"), lambda x: d.distinct(x))


def listed_companies(d: Dialect, section: str) -> str:
    """A record for each registration number with the company's name before it or after it."""
    digits = d.extract("g", "([0-9]{3,15})$", 1)
    loose = d.nonempty(f"regexp_extract({section}, concat({d.text('[A-Za-z0-9]{1,10}' + chr(92) + 's*[–—-]' + chr(92) + 's*')}, {digits}), 0)")

    def named(shown: str) -> str:
        at = d.place(section, shown)
        before, after = around(d, section, at, f"length({shown})", 220, 120)
        name = f"coalesce({listed_company(d, before)}, {listed_company(d, after)})"
        return f"case when {at} > 0 then {d.let(name, lambda n: f'case when {n} is not null then {record(d, "structured_target_list", n, registration="g")} end')} end"

    return some(d, d.map(registrations(d, section), "g", d.let(f"coalesce({loose}, g)", named)))


def listed(d: Dialect, text: str) -> str:
    """The records of the target list, persons before companies."""
    both = lambda s: f"case when {s} = '' then {d.slice(listed_persons(d, s), '1', '0')} else {dedupe(d, d.concat_arrays(listed_persons(d, s), listed_companies(d, s)))} end"
    return d.let(target_section(d, text), both)


def unseen(d: Dialect, value: str, *seen: str) -> str:
    """Whether none of the seen records has an id."""
    return " and ".join(f"not coalesce({d.has(d.map(s, 'o', 'o.national_id'), value)}, false)" for s in seen)


def context_records(d: Dialect, text: str, *seen: str) -> str:
    """A record for each line with an id, whose name stands on the line, the next or the previous one, in this order.

    No name is looked for if seen records have the id.
    """
    def of_line(x: str) -> str:
        joined = f"concat_ws(' ', v, {d.at(x, 'i + 1')}, {d.at(x, 'nullif(i, 1) - 1')})"
        context = E.squeeze(d, d.translate(joined, "()،", "   "))
        return d.map_with(x, "v", "i", f"case when {d.size(E.national_ids(d, 'v'))} > 0 then {d.struct(id=d.at(E.national_ids(d, 'v'), '1'), context=context)} end")

    def name(part: str) -> str:
        rest = "case " + " ".join(f"when {d.contains('{0}', d.text(h))} then substr({{0}}, {d.place('{0}', d.text(h))} + {len(h)})" for h in L.PERSON_HINTS) + " else {0} end"
        words = d.let(part, lambda t: E.clean_words(d, E.arabic_words(d, E.cut_stop_phrases(d, rest.replace("{0}", t)))))
        return d.let(words, lambda w: d.let(f"case when {d.size(w)} >= 3 then {tail(d, w, 5)} end", lambda n: f"case when {E.valid_name(d, n, 'false')} then {n} end"))

    at = d.place("ctx.context", "ctx.id")
    found = f"coalesce({name(f'substr(ctx.context, 1, {d.integer(f'greatest({at} - 1, 0)')})')}, {name(f'substr(ctx.context, {d.integer(f'{at} + length(ctx.id)')})')})"
    made = d.let(found, lambda n: f"case when {n} is not null and {at} > 0 then {record(d, 'national_id_context', n, 'ctx.id')} end")
    places = some(d, d.let(lines_of(d, text), of_line))
    return some(d, d.map(d.filter(places, "z", unseen(d, "z.id", *seen)) if seen else places, "ctx", made))


def emergency_records(d: Dialect, text: str, *seen: str) -> str:
    """A weak record for each id that no seen record has: a run of names after its first place, else before it."""
    invalid = tuple(dict.fromkeys(L.INVALID_NAME_WORDS + L.LABEL_NOISE))

    def name(part: str, after: str) -> str:
        cleaned = E.squeeze(d, d.translate(E.cut_stop_phrases(d, part), "()[]،:-", "       "))

        def pick(t: str) -> str:
            runs = d.filter(segments(d, E.clean_words(d, E.arabic_words(d, t)), invalid), "v", f"{d.size(words_of(d, 'v'))} >= 3")
            one = d.let(runs, lambda r: f"case when {t} = {after} then {d.at(r, '1')} else {d.at(r, f'nullif({d.size(r)}, 0)')} end")
            return d.let(one, lambda v: f"case when {v} is not null then {tail(d, words_of(d, v), 5)} end")

        return d.let(cleaned, pick)

    def of_text(t: str) -> str:
        at = d.place(t, "i")
        before, after = around(d, t, at, "length(i)", 450, 180)
        found = f"coalesce({name(after, after)}, {name(before, after)})"
        ids = d.filter(E.national_ids(d, t), "z", unseen(d, "z", *seen)) if seen else E.national_ids(d, t)
        return some(d, d.map(ids, "i", d.let(found, lambda n: f"case when {n} is not null then {record(d, 'emergency_national_id_context', n, 'i', confidence='0.65', review='true')} end")))

    return d.let(E.squeeze(d, text), of_text)


def orphan_names(d: Dialect, text: str) -> str:
    """Distinct first names that stand alone on a line, from the list's heading on (without one, anywhere)."""
    def of_lines(x: str) -> str:
        start = d.first_place(x, "v", E.any_phrase(d, "v", L.LIST_HEADINGS))
        rest = d.slice(x, d.integer(f"greatest({start}, 1)"), d.integer(f"greatest({d.size(x)}, 1)"))
        alone = d.filter(d.map(rest, "v", E.arabic_words(d, "v")), "w", f"{d.size('w')} = 1")
        words = d.map(alone, "w", d.let(d.at("w", "1"), lambda v: E.fix_word(d, v)))
        return d.let(d.filter(words, "w", f"{d.among('w', L.FIRST_NAMES)} and not {d.among('w', L.ORPHAN_NOISE)}"), lambda n: d.distinct(n))

    return d.let(lines_of(d, text), of_lines)


def empty(d: Dialect, records: str) -> str:
    """No records, of the same kind."""
    return d.slice(records, "1", "0")


def changed(d: Dialect, r: str, **fields: str) -> str:
    return d.struct(**{n: fields.get(n, f"{r}.{n}") for n in RECORD})


def score(d: Dialect, r: str) -> str:
    """How good a record is to the extractor; a merge has its own score."""
    has = lambda x: f"coalesce({r}.{x}, '') <> ''"
    words = f"case when {has('full_name')} then {d.size(d.split(E.squeeze(d, f'{r}.full_name'), ' '))} else 0 end"
    parts = [(has("national_id"), 10), (has("registration_number"), 10), (f"{r}.source = 'rules'", 6), (f"{r}.extraction_method = 'structured_target_list'", 5), (f"{r}.extraction_method = 'direct_legal_phrase'", 4), (f"not {r}.needs_review", 2)]
    return "(" + " + ".join(f"case when {test} then {n} else 0 end" for test, n in parts) + f" + {words})"


def dedupe(d: Dialect, records: str) -> str:
    """The extractor's records by id or registration number, in order.

    The better of two of one name stays in the first one's place. If names differ, both are to be reviewed (which costs the one
    that stays its points for later comparisons), and the later one is kept behind the others if its name is new and,
    unless it is a company's, a full one.
    """
    key = "case when coalesce({0}.national_id, '') <> '' then concat('id:', {0}.national_id) when coalesce({0}.registration_number, '') <> '' then concat('reg:', {0}.registration_number) end"
    rows = d.map(records, "v", d.struct(key=key.format("v"), kept="true", r="v"))
    if d.spark:  # the records are computed once, and the place once a step
        return d.let(rows, lambda r: _dedupe(d, r))
    return _dedupe(d, rows)


def _dedupe(d: Dialect, rows: str) -> str:
    none = d.slice(rows, "1", "0")
    place = d.first_place("acc", "e", "e.kept and e.key = x.key")
    return _dedupe_finish(d, d.fold(rows, none, "acc", "x", d.let(place, lambda at: _dedupe_step(d, at)) if d.spark else _dedupe_step(d, place)))


def _dedupe_step(d: Dialect, at: str) -> str:
    """The state ``acc`` with the row ``x``, whose key stands at a place (0: nowhere)."""
    old = d.at("acc", f"nullif({at}, 0)")
    add = lambda kept, r: d.concat_arrays("acc", d.items(d.struct(key="x.key", kept=kept, r=r)))
    differ = f"coalesce({old}.r.full_name, '') <> '' and coalesce(x.r.full_name, '') <> '' and {old}.r.full_name <> x.r.full_name"
    doubted = d.map_with("acc", "e", "j", f"case when j = {at} then {d.struct(key='e.key', kept='e.kept', r=changed(d, 'e.r', needs_review='true'))} else e end")
    better = d.map_with("acc", "e", "j", f"case when j = {at} and {score(d, 'x.r')} > {score(d, 'e.r')} then x else e end")
    doubled = d.concat_arrays(doubted, d.items(d.struct(key="x.key", kept="false", r=changed(d, "x.r", needs_review="true"))))
    return f"case when x.key is null then {add('false', 'x.r')} when {at} = 0 then {add('true', 'x.r')} when {differ} then {doubled} else {better} end"


def _dedupe_finish(d: Dialect, folded: str) -> str:
    def finish(f: str) -> str:
        rest = d.filter(f, "v", "not v.kept and coalesce(v.r.full_name, '') <> ''")
        new = f"not coalesce({d.has(d.map('acc', 'e', 'e.r.full_name'), 'x.r.full_name')}, false) and (coalesce(x.r.person_type, '') = 'Company' or {E.valid_name(d, 'x.r.full_name', 'false')})"
        out = d.fold(rest, d.filter(f, "v", "v.kept"), "acc", "x", f"case when {new} then {d.concat_arrays('acc', d.items('x'))} else acc end")
        return d.map(out, "e", "e.r")

    return d.let(folded, finish)


def recover_orphans(d: Dialect, records: str, orphans: str) -> str:
    """The k-th record whose three-word name lacks its first name takes the k-th orphan; a name that is there already uses none up."""
    methods = ("structured_target_list", "national_id_context", "emergency_national_id_context")

    def with_names(names: str) -> str:
        rows = d.map(records, "v", d.struct(k="0", r="v"))
        used = f"coalesce({d.at('acc', f'nullif({d.size('acc')}, 0)')}.k, 0)"
        words = d.split(E.squeeze(d, "coalesce(x.r.full_name, '')"), " ")
        name = d.at(names, f"{used} + 1")
        fits = f"x.r.person_type = 'Individual' and coalesce(x.r.national_id, '') <> '' and {d.size(words)} = 3 and {d.has(d.array(methods), 'x.r.extraction_method')} and {name} is not null and not {d.has(words, name)}"
        new = changed(d, "x.r", full_name=E.squeeze(d, f"concat({name}, ' ', x.r.full_name)"), confidence="cast(0.85 as double)", needs_review="true", extraction_method="'orphan_first_name_recovered'")
        step = f"case when coalesce({fits}, false) then {d.concat_arrays('acc', d.items(d.struct(k=f'{used} + 1', r=new)))} else {d.concat_arrays('acc', d.items(d.struct(k=used, r='x.r')))} end"
        return d.map(d.fold(rows, d.slice(rows, "1", "0"), "acc", "x", step), "e", "e.r")

    return d.let(orphans, with_names)


def phrase_records(d: Dialect, text: str) -> str:
    return d.map(P.direct_phrases(d, text), "p", record(d, "direct_legal_phrase", "p.full_name", "p.national_id"))


def line_records(d: Dialect, text: str) -> str:
    made = d.map(P.candidate_lines(d, lines_of(d, text)), "l", P.keyword_line(d, "l"))
    full = {n: f"q.{n}" for n in RECORD[:6]} | {"source": "'rules'", "extraction_method": "'keyword_line'"}
    return d.map(some(d, made), "q", d.struct(**full))


def without(d: Dialect, records: str, seen: str, field: str) -> str:
    """The records whose field none of the seen ones has."""
    return d.filter(records, "u", f"not coalesce({d.has(d.map(seen, 'o', f'o.{field}'), f'u.{field}')}, false)")


def dedupe_output(d: Dialect, records: str) -> str:
    """One record of each id (a direct phrase beats others, else more words), then records without an id by new names."""
    size = lambda r: f"case when coalesce({r}.full_name, '') <> '' then {d.size(d.split(E.squeeze(d, f'{r}.full_name'), ' '))} else 0 end"
    direct = lambda r: f"coalesce({r}.extraction_method, '') = 'direct_legal_phrase'"
    at = d.first_place("acc", "e", "e.national_id = x.national_id")
    swapped = d.map_with("acc", "e", "j", f"case when j = {at} and (({direct('x')} and not {direct('e')}) or {size('x')} > {size('e')}) then x else e end")
    by_id = d.fold(d.filter(records, "v", "coalesce(v.national_id, '') <> ''"), empty(d, records), "acc", "x", f"case when {at} = 0 then {d.concat_arrays('acc', d.items('x'))} else {swapped} end")
    new = f"not coalesce({d.has(d.map('acc', 'e', 'e.full_name'), 'x.full_name')}, false)"
    others = d.filter(records, "v", "coalesce(v.national_id, '') = '' and coalesce(v.full_name, '') <> ''")
    return d.fold(others, by_id, "acc", "x", f"case when {new} then {d.concat_arrays('acc', d.items('x'))} else acc end")


def validated(d: Dialect, records: str) -> str:
    """The records as the person validation leaves them."""
    return d.map(records, "p", d.let(P.validate(d, "p"), lambda v: d.struct(**{n: f"{v}.{n}" for n in RECORD[:6]}, source="p.source", extraction_method="p.extraction_method")))
