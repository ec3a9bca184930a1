"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

A token budget goes down a domain-language-source tree. Among siblings it is shared by weight, no node getting more than
the tokens below it times the allowed epochs; what a short node can't take goes to its siblings, and only what all of them
can't take is left to their parent's siblings. A leaf's amount A over T available tokens is A div T whole epochs, and from the
next epoch, an order by a seeded hash, the first A mod T tokens; the last document of it is cut.

All amounts are integers, so the result is exact and the same on any cluster. No window holds a leaf's documents: the epoch
order is by hash bucket, buckets are summed first, and only the bucket in which the amount ends is ordered.

A null text has no tokens and, as every text without tokens, is never taken; a null language or source is the empty name. Equal
rows are taken apart from each other, in any order among them; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from writlake.llm.common import WORD, Scratch, prepare

#: The tree of the corpus: a domain's name from its source's, and weights of names at each level (others: 1).
DOMAIN = "concat('d', ascii(right(coalesce(source, ''), 1)) % 3)"
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "fr": 2, "de": 2}, "source": {"src0": 4}}
LEVELS = ("domain", "lang", "source")
#: The mixture of the registered query: the budget in thousandths of all tokens, and the most epochs of a leaf.
BUDGET_PERMILLE, EPOCHS, SEED, HEX = 600, 3, 7, 3


def weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("decimal(10,0)")


def share(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Give each parent's ``budget`` to its children by ``weight`` with the limit ``cap``; siblings meet in one window, which holds names, not documents.

    Ordered by cap over weight, children are full as long as cap * (weight from here on) <= weight * (budget left here);
    the others share the rest by weight, rounded along their order so that the sum is exact and none passes its cap.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    money = "decimal(24,0)"
    out = nodes.withColumns({
        "w_left": F.sum("weight").over(Window.partitionBy(*parents)) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "left": F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
    })
    out = out.withColumn("full", F.col("cap").cast(money) * F.col("w_left").cast("decimal(12,0)") <= F.col("weight").cast("decimal(12,0)") * F.col("left").cast(money))
    # Rounding in the order makes a later node full where an earlier, equal one is not: full nodes are a prefix.
    out = out.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = Window.partitionBy(*parents, "full")
    up_to = rest.orderBy(F.col("cap") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"w_all": F.sum("weight").over(rest), "w_to": F.sum("weight").over(up_to), "rest": F.max("left").over(rest)})
    cut = lambda w: F.expr(f"cast(rest as {money}) * cast({w} as decimal(12,0)) div cast(w_all as decimal(12,0))")
    amount = F.when(F.col("full"), F.col("cap")).otherwise(cut("w_to") - cut("(w_to - weight)"))
    return out.withColumn("budget", amount.cast("long")).drop("w_left", "left", "full", "w_all", "w_to", "rest")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """``budget`` of each leaf from ``tokens`` by leaf; ``budget`` is a Column over ``total``, the tokens of all leaves."""
    nodes = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    level_nodes = total.select(F.least(budget, F.col("total") * epochs).cast("long").alias("budget"), F.lit(0).alias("root"))
    parents = ["root"]
    for i, level in enumerate(LEVELS):
        path = list(LEVELS[: i + 1])
        own = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("root", F.lit(0)).withColumn("weight", weight(level, weights))
        level_nodes = share(own.join(level_nodes.select(*parents, "budget"), parents), parents, level)
        parents = path
    return nodes.select(*LEVELS, "tokens").join(level_nodes.select(*LEVELS, "budget"), list(LEVELS))


def keyed(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """The rows with the tree's names, their number of tokens and a checksum of the text."""
    text = "coalesce(text, '')"
    names = {"__domain": F.expr(domain), "__lang": F.expr("coalesce(lang, '')"), "__source": F.expr("coalesce(source, '')")}
    return docs.withColumns(names | {"__tokens": F.regexp_count(F.expr(text), F.lit(WORD)).cast("long"), "__sum": F.expr(f"md5(cast({text} as binary))")})


def select_prefixes(rows: DataFrame, budgets: DataFrame, seed: int, scratch: Scratch, carry: list[str]) -> DataFrame:
    """``carry`` columns and tree names of ``keyed`` rows with ``epoch`` and ``take``, the tokens taken; a row may come once for each epoch."""
    plan = budgets.where("budget > 0").select(*(F.col(x).alias(f"__{x}") for x in LEVELS), F.expr("budget div tokens").alias("__whole"), F.expr("budget % tokens").alias("__part"))
    names = [f"__{x}" for x in LEVELS]
    rows = rows.where("__tokens > 0").select(*carry, *names, "__tokens", "__sum").join(plan, names)
    rows = rows.withColumn("__hash", F.expr(f"md5(cast(concat_ws('|', '{seed}', __whole, coalesce(cast(doc_id as string), ''), __sum) as binary))"))
    rows = rows.withColumn("__bucket", F.substring("__hash", 1, HEX))
    whole = rows.where("__whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(__whole as int) - 1)"))).withColumn("take", F.col("__tokens"))
    sums = rows.where("__part > 0").groupBy(*names, "__bucket", "__part").agg(F.sum("__tokens").alias("__n"))
    order = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).where("__before < __part and __before + __n >= __part")
    ends = scratch.keep(ends.select(*names, F.col("__bucket").alias("__end"), (F.col("__part") - F.col("__before")).alias("__need")), "ends")
    partial = rows.where("__part > 0").join(ends, names).withColumn("epoch", F.col("__whole").cast("int"))
    below = partial.where("__bucket < __end").withColumn("take", F.col("__tokens"))
    inside = Window.partitionBy(*names).orderBy("__hash", "doc_id", "__tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = partial.where("__bucket = __end").withColumn("__done", F.coalesce(F.sum("__tokens").over(inside), F.lit(0))).where("__done < __need")
    edge = edge.withColumn("take", F.least(F.col("__tokens"), F.col("__need") - F.col("__done")))
    keep = [*carry, *names, "__tokens", "epoch", "take"]
    return whole.select(*keep).unionByName(below.select(*keep)).unionByName(edge.select(*keep))


def mix(docs: DataFrame, permille: int = BUDGET_PERMILLE, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, dict[str, int]] | None = None, domain: str = DOMAIN, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mixture: ``carry`` columns, domain, lang, source, ``doc_tokens``, ``epoch`` and ``take`` of every taken row and epoch."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    rows = keyed(docs.select("text", "lang", "source", *(c for c in carry if c not in ("text", "lang", "source"))), domain)
    if "text" not in carry:
        rows = scratch.keep(rows.drop("text"), "keyed")
    leaves = scratch.keep(rows.where("__tokens > 0").groupBy(*(F.col(f"__{x}").alias(x) for x in LEVELS)).agg(F.sum("__tokens").alias("tokens")), "leaves")
    budgets = leaf_budgets(leaves, F.expr(f"total * {permille} div 1000"), epochs, weights or WEIGHTS)
    taken = select_prefixes(rows, scratch.keep(budgets, "budgets"), seed, scratch, list(carry))
    tree = {x: F.col(f"__{x}") for x in LEVELS if x not in carry}
    return taken.select(*carry, *(c.alias(x) for x, c in tree.items()), F.col("__tokens").alias("doc_tokens"), "epoch", "take")


def cut_text(text: str, take: str, tokens: str) -> Column:
    """The text up to its ``take``-th token; the whole text where all are taken."""
    first = f"array_join(slice(regexp_extract_all({text}, '([\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+)', 1), 1, cast({take} as int)), '')"
    return F.expr(f"if({take} >= {tokens}, {text}, {first})")


def _share_sql(child: str, parent: str, keys: str, level: str) -> str:
    by = f"partition by {keys}" if keys else ""
    return f"""
{child}_a as (select c.*, p.budget as b, sum(weight) over ({by}) - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as w_left,
    p.budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as l
  from {child}_n c join (select root{', ' + keys if keys else ''}, budget from {parent}) p using (root{', ' + keys if keys else ''}) window o as ({by} order by cap::double / weight, {level})),
{child}_b as (select *, min((cap::hugeint * w_left <= weight * l::hugeint)::int) over ({by} order by cap::double / weight, {level} rows between unbounded preceding and current row) as f from {child}_a),
{child}_c as (select *, sum(weight) over (partition by {keys + ', ' if keys else ''} f) as w_all, sum(weight) over (partition by {keys + ', ' if keys else ''} f order by cap::double / weight, {level} rows between unbounded preceding and current row) as w_to,
    max(l) over (partition by {keys + ', ' if keys else ''} f) as rest from {child}_b),
{child}_s as (select * exclude (b, w_left, l, f, w_all, w_to, rest), (case when f = 1 then cap else (rest::hugeint * w_to) // w_all - (rest::hugeint * (w_to - weight)) // w_all end)::bigint as budget from {child}_c)"""


def oracle_sql() -> str:
    """The registered mixture in DuckDB's SQL."""
    case = {k: "case " + k + "".join(f" when '{n}' then {w}" for n, w in WEIGHTS[k].items()) + " else 1 end" for k in LEVELS}
    domain = "'d' || (ascii(right(coalesce(source, ''), 1)) % 3)"
    return f"""
with keyed as (select doc_id, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as tokens, md5(coalesce(text, '')) as s from documents),
held as (select * from keyed where tokens > 0),
leaves as (select domain, lang, source, sum(tokens)::bigint as tokens from held group by all),
root as (select 0 as root, least(sum(tokens)::bigint * {BUDGET_PERMILLE} // 1000, sum(tokens)::bigint * {EPOCHS})::bigint as budget from leaves),
one_n as (select 0 as root, domain, sum(tokens)::bigint * {EPOCHS} as cap, {case['domain']} as weight from leaves group by domain),
{_share_sql('one', 'root', '', 'domain')},
two_n as (select 0 as root, domain, lang, sum(tokens)::bigint * {EPOCHS} as cap, {case['lang']} as weight from leaves group by domain, lang),
{_share_sql('two', 'one_s', 'domain', 'lang')},
three_n as (select 0 as root, domain, lang, source, tokens * {EPOCHS} as cap, {case['source']} as weight from leaves),
{_share_sql('three', 'two_s', 'domain, lang', 'source')},
plan as (select domain, lang, source, budget // tokens as whole, budget % tokens as part from three_s join leaves using (domain, lang, source) where budget > 0),
hashed as (select s.*, whole, part, md5(concat_ws('|', '{SEED}', whole, coalesce(doc_id::varchar, ''), s)) as h from held s join plan using (domain, lang, source)),
ordered as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by h, doc_id, tokens rows between unbounded preceding and 1 preceding), 0) as done from hashed),
taken as (select doc_id, domain, lang, source, tokens as doc_tokens, e as epoch, tokens as take from (select *, unnest(range(whole)) as e from hashed)
  union all select doc_id, domain, lang, source, tokens, whole, least(tokens, part - done) from ordered where done < part)
select doc_id::bigint as doc_id, domain, lang, source, doc_tokens::bigint as doc_tokens, epoch::int as epoch, take::bigint as take from taken"""
