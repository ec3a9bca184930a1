"""Order-dependent folds over a document's records and detections, as higher-order functions on arrays: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "struct<full_name:string,national_id:string,registration_number:string,person_type:string,confidence:double,needs_review:boolean,source:string,extraction_method:string>"
_NAME = r"regexp_replace(trim(coalesce({0}.full_name, '')), '\\s+', ' ')"
_WORDS = "if(coalesce({0}.full_name, '') = '', 0, size(split(" + _NAME + ", ' ')))"
_SCORE = "(if(coalesce({0}.national_id, '') <> '', 10, 0) + if({0}.source = 'rules', 8, 0) + if({0}.extraction_method = 'direct_legal_phrase', 4, 0) + " + _WORDS + " + if({0}.needs_review, 0, 2))"


def _replace(array: str, place: str, value: str) -> str:
    return f"transform({array}, (e, i) -> if(i = {place}, {value}, e))"


def dedupe_for_output(records: str) -> Column:
    """One record of each id (a direct phrase beats others, else more words), then records without id by new names."""
    better = f"(r.extraction_method = 'direct_legal_phrase' and not (acc[p].extraction_method <=> 'direct_legal_phrase')) or {_WORDS.format('r')} > {_WORDS.format('acc[p]')}"
    with_id = f"aggregate(filter({records}, r -> coalesce(r.national_id, '') <> ''), cast(array() as array<{RECORD}>), (acc, r) -> transform(array(array_position(transform(acc, e -> e.national_id), r.national_id) - 1), p -> if(p < 0, concat(acc, array(r)), transform(acc, (e, i) -> if(i = p and ({better.replace('acc[p]', 'e')}), r, e))))[0])"
    return F.expr(f"aggregate(filter({records}, r -> coalesce(r.national_id, '') = '' and coalesce(r.full_name, '') <> ''), {with_id}, (acc, r) -> if(array_contains(transform(acc, e -> e.full_name), r.full_name), acc, concat(acc, array(r))))")


def _merged(a: str, b: str) -> str:
    """Two records of one person: the better one, filled from the other."""
    best, other = f"if({_SCORE.format(b)} > {_SCORE.format(a)}, {b}, {a})", f"if({_SCORE.format(b)} > {_SCORE.format(a)}, {a}, {b})"
    return (
        f"transform(array(named_struct('x', {best}, 'y', {other})), z -> named_struct('full_name', z.x.full_name, 'national_id', if(coalesce(z.x.national_id, '') <> '', z.x.national_id, z.y.national_id), 'registration_number', if(coalesce(z.x.registration_number, '') <> '', z.x.registration_number, z.y.registration_number), "
        f"'person_type', z.x.person_type, 'confidence', z.x.confidence, 'needs_review', if(z.x.national_id is not null and {_WORDS.format('z.x')} >= 3, false, z.x.needs_review), "
        f"'source', if(z.x.source <> z.y.source and 'rules' in (z.x.source, z.y.source), 'rules+ner', z.x.source), 'extraction_method', coalesce(z.x.extraction_method, z.y.extraction_method)))[0]"
    )


def dedupe_merge(records: str) -> Column:
    """Records of one id merged in order, then those without id into the first record whose name holds theirs or is held by it."""
    def fold(some: str, start: str, place: str) -> str:
        return f"aggregate({some}, {start}, (acc, r) -> transform(array({place}), p -> if(p < 0, concat(acc, array(r)), transform(acc, (e, i) -> if(i = p, {_merged('e', 'r')}, e))))[0])"

    by_id = fold(f"filter({records}, r -> coalesce(r.national_id, '') <> '')", f"cast(array() as array<{RECORD}>)", "array_position(transform(acc, e -> e.national_id), r.national_id) - 1")
    alike = f"coalesce({_NAME.format('e')} <> '' and {_NAME.format('r')} <> '' and (contains({_NAME.format('e')}, {_NAME.format('r')}) or contains({_NAME.format('r')}, {_NAME.format('e')})), false)"
    return F.expr(fold(f"filter({records}, r -> coalesce(r.national_id, '') = '')", by_id, f"array_position(transform(acc, e -> {alike}), true) - 1"))


def dedupe_merge_sql(records: str, key: str) -> str:
    """``dedupe_merge`` over a DuckDB query of records with a rank, as its own folds: the SQL that checks it."""
    names = [f.split(":")[0] for f in RECORD[7:-1].split(",")]
    name = "regexp_replace(trim(coalesce({0}.full_name, '')), '\\s+', ' ', 'g')"
    words = "case when coalesce({0}.full_name, '') = '' then 0 else len(string_split(" + name + ", ' ')) end"
    score = "(case when coalesce({0}.national_id, '') <> '' then 10 else 0 end + case when {0}.source = 'rules' then 8 else 0 end + case when {0}.extraction_method = 'direct_legal_phrase' then 4 else 0 end + " + words + " + case when {0}.needs_review then 0 else 2 end)"
    wins = f"{score.format('r[1]')} > {score.format('e')}"
    filled = {n: f"z.x.{n}" for n in names} | {n: f"case when coalesce(z.x.{n}, '') <> '' then z.x.{n} else z.y.{n} end" for n in ("national_id", "registration_number")} | {"extraction_method": "coalesce(z.x.extraction_method, z.y.extraction_method)"}
    filled["needs_review"] = f"case when z.x.national_id is not null and {words.format('z.x')} >= 3 then false else z.x.needs_review end"
    filled["source"] = "case when z.x.source <> z.y.source and 'rules' in (z.x.source, z.y.source) then 'rules+ner' else z.x.source end"
    both = f"[{{'x': case when {wins} then r[1] else e end, 'y': case when {wins} then e else r[1] end}}]"
    merged = f"list_transform({both}, lambda z: {{{', '.join(f"'{n}': {x}" for n, x in filled.items())}}})[1]"
    alike = f"{name.format('e')} <> '' and {name.format('r[1]')} <> '' and (contains({name.format('e')}, {name.format('r[1]')}) or contains({name.format('r[1]')}, {name.format('e')}))"

    def fold(test: str, start: str, place: str) -> str:
        step = f"list_transform([coalesce({place}, 0)], lambda p: case when p = 0 then list_concat(acc, r) else list_transform(acc, lambda e, i: case when i = p then {merged} else e end) end)[1]"
        return f"list_reduce(list_transform(list_filter(records, lambda v: {test}), lambda v: [v]), lambda acc, r: {step}, {start})"

    by_id = fold("coalesce(v.national_id, '') <> ''", "list_slice(records, 1, 0)", "list_position(list_transform(acc, lambda e: e.national_id), r[1].national_id)")
    persons = fold("coalesce(v.national_id, '') = ''", by_id, f"list_position(list_transform(acc, lambda e: {alike}), true)")
    order = ", ".join(["rank", *(f"{n} nulls first" for n in names)])
    grouped = f"select {key}, list({{{', '.join(f"'{n}': {n}" for n in names)}}} order by {order}) as records from ({records}) group by {key}"
    return f"select {key}, {persons} as persons from ({grouped})"


def reading_order(detections: str) -> Column:
    """Texts of detections {bbox, text, conf} from top to bottom and right to left.

    A row goes on while the next box's centre is within 0.6 of the upper median height (6 at least) of the row's running
    centre, which moves half way to each box; ties keep the order of detection.
    """
    y = "(array_min(transform({0}.bbox, p -> p[1])) + array_max(transform({0}.bbox, p -> p[1]))) / 2"
    items = f"transform({detections}, (b, i) -> named_struct('y', {y.format('b')}, 'i', i, 'x', array_min(transform(b.bbox, p -> p[0])), 'h', array_max(transform(b.bbox, p -> p[1])) - array_min(transform(b.bbox, p -> p[1])), 'text', b.text))"
    kind = "struct<row:int,nx:double,i:int,text:string>"
    heights = f"sort_array(transform({items}, b -> b.h))"
    reach = f"greatest(0.6 * coalesce(get({heights}, cast(size({heights}) div 2 as int)), 20.0), 6.0)"
    start = f"named_struct('row', 0, 'y', cast(null as double), 'reach', cast({reach} as double), 'out', cast(array() as array<{kind}>))"
    near = "(s.y is null or abs(b.y - s.y) <= s.reach)"
    row = f"if({near}, s.row, s.row + 1)"
    step = f"named_struct('row', {row}, 'y', cast(if({near} and s.y is not null, (s.y + b.y) / 2, b.y) as double), 'reach', s.reach, 'out', concat(s.out, array(cast(named_struct('row', {row}, 'nx', -b.x, 'i', b.i, 'text', b.text) as {kind}))))"
    return F.expr(f"transform(array_sort(aggregate(array_sort({items}), {start}, (s, b) -> {step}, s -> s.out)), b -> b.text)")
