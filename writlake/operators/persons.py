"""Persons and companies: direct phrases, keyword lines, group splitting, validation and scores."""

from __future__ import annotations

from writlake.functions import expressions as E
from writlake.functions import lexicons as L
from writlake.functions.dialect import Dialect

KEYWORDS_LONGEST_FIRST = tuple(sorted(L.PERSON_LINE_KEYWORDS, key=len, reverse=True))


def clean_name(d: Dialect, text: str) -> str:
    """Words of a name without what follows a stop phrase, misread words mended."""
    return d.join(E.clean_words(d, E.arabic_words(d, E.cut_stop_phrases(d, text))), " ")


def direct_phrases(d: Dialect, text: str) -> str:
    """name and id wherever a phrase, a name, an id's label and 11 digits follow each other; in order of the phrases."""
    def found(x: str) -> str:
        out = []
        for phrase in L.DIRECT_PHRASES:
            pattern = rf"{phrase}\s*[:-]?\s*([{E.ARABIC}\s]{{5,120}}?)\s*{L.ID_CONNECTOR}\s*[:-]?\s*[(\[]?\s*([0-9]{{11}})"
            matches = d.extract_all(x, pattern, 0)
            if d.spark:
                matches = f"case when {d.contains(x, d.text(phrase))} then {matches} else cast(array() as array<string>) end"
            out.append(d.map(matches, "m", d.struct(full_name=clean_name(d, f"coalesce({d.extract('m', pattern, 1)}, '')"), national_id=d.extract("m", pattern, 2))))
        return d.filter(d.concat_arrays(*out), "p", E.valid_name(d, "p.full_name", "true"))

    return d.let(E.squeeze(d, text), found)


def candidate_lines(d: Dialect, lines: str) -> str:
    """Each line with a person's keyword, and the next line."""
    return d.let(lines, lambda x: _candidate_lines(d, x)) if d.spark else _candidate_lines(d, lines)


def _candidate_lines(d: Dialect, lines: str) -> str:
    if d.spark:
        pairs = f"transform({lines}, (v, i) -> {d.struct(line='v', both=f'concat_ws({d.text(" ")}, v, get({lines}, i + 1))')})"
    else:
        pairs = f"list_transform({lines}, lambda v, i: {d.struct(line='v', both=f'concat_ws({d.text(" ")}, v, list_extract({lines}, i + 1))')})"
    return d.map(d.filter(pairs, "p", E.any_phrase(d, "p.line", L.PERSON_LINE_KEYWORDS)), "p", "p.both")


def keyword_line(d: Dialect, line: str) -> str:
    """The record of a candidate line, or null."""
    rest = "case " + " ".join(f"when {d.contains('{0}', d.text(k))} then substr({{0}}, {'instr' if d.spark else 'strpos'}({{0}}, {d.text(k)}) + {len(k)})" for k in KEYWORDS_LONGEST_FIRST) + " end"

    def record(v: str) -> str:
        tail = rest.replace("{0}", v)
        first_id = d.at(E.national_ids(d, v), "1")
        body = d.let(tail, lambda t: d.let(d.at(E.national_ids(d, t), "1"), lambda i: f"case when {i} is not null then substring_index({t}, {i}, 1) else {t} end") if d.spark else f"case when {d.at(E.national_ids(d, t), '1')} is not null then split_part({t}, {d.at(E.national_ids(d, t), '1')}, 1) else {t} end")
        name = clean_name(d, body)
        reg = E.registration(d, v)
        return d.let(name, lambda n: (
            f"case when {E.is_recipient(d, v)} or length({n}) < 5 then null "
            f"when {E.is_company(d, v)} then {d.struct(full_name=n, national_id=null(d), registration_number=reg, person_type="'Company'", confidence='cast(0.75 as double)', needs_review='true')} "
            f"when not {E.valid_name(d, n, 'false')} then null "
            f"when {first_id} is not null then {d.struct(full_name=n, national_id=first_id, registration_number=null(d), person_type="'Individual'", confidence='cast(0.90 as double)', needs_review='false')} "
            f"else {d.struct(full_name=n, national_id=null(d), registration_number=null(d), person_type="'Individual'", confidence='cast(0.55 as double)', needs_review='true')} end"
        ))

    return d.let(line, record)


def null(d: Dialect) -> str:
    return f"cast(null as {'string' if d.spark else 'varchar'})"


def split_group(d: Dialect, name: str) -> str:
    """Full names of a group with a family tail; a name without one stays alone. Every و parts names, also inside words."""
    out = []
    for keyword in L.FAMILY_TAIL_KEYWORDS:
        at = f"{'instr' if d.spark else 'strpos'}({name}, {d.text(keyword)})"
        head, tail = E.trim(d, f"substr({name}, 1, {at} - 1)"), E.trim(d, f"substr({name}, {at} + {len(keyword)})")
        parts = d.filter(d.map(d.split(head, r"\s*(?:و|،|/)\s*"), "v", E.trim(d, "v")), "v", "v <> ''")
        whole = d.matches(f"concat(' ', {name}, ' ')", rf"\s{keyword}\s")
        out.append(f"when {whole} and {at} > 1 then case when {d.size(parts)} >= 2 and {tail} <> '' then {d.map(parts, 'v', f'concat(v, {d.text(" ")}, {tail})')} else {d.items(name)} end")
    return f"case {' '.join(out)} else {d.items(name)} end"


def validate(d: Dialect, p: str) -> str:
    """Types outside the two become individuals; ids of a company or of an impossible shape go; what is doubtful is to be reviewed."""
    kind = f"case when {p}.person_type in ('Individual', 'Company') then {p}.person_type else 'Individual' end"
    status = E.id_status(d, f"{p}.national_id")
    keep = f"({kind}) = 'Individual' and ({status}) in ('valid', 'plausible')"
    review = f"({p}.needs_review or coalesce({p}.full_name, '') = '' or {p}.person_type is null or {p}.person_type not in ('Individual', 'Company') or ({status}) in ('plausible', 'invalid') or (({kind}) = 'Company' and {p}.national_id is not null) or {p}.confidence < {L.REVIEW_BELOW})"
    return d.struct(full_name=f"{p}.full_name", national_id=f"case when {keep} then {p}.national_id end", registration_number=f"{p}.registration_number", person_type=kind, confidence=f"{p}.confidence", needs_review=review)


def merge_score(d: Dialect, name: str, national_id: str, source: str, method: str, review: str) -> str:
    words = f"case when coalesce({name}, '') = '' then 0 else {d.size(d.split(E.squeeze(d, name), ' '))} end"
    return f"(case when {national_id} is not null then 10 else 0 end + case when {source} = 'rules' then 8 else 0 end + case when {method} = 'direct_legal_phrase' then 4 else 0 end + {words} + case when not {review} then 2 else 0 end)"


def nearby_id(d: Dialect, text: str, start: str, end: str, reach: int = 120) -> str:
    """The leftmost id in a window around a span; the window's edge may cut a longer run of digits."""
    return d.at(E.national_ids(d, f"substr({text}, cast(greatest({start} - {reach}, 0) as int) + 1, cast(least({end} + {reach}, length({text})) - greatest({start} - {reach}, 0) as int))"), "1")
