"""Operator 7: mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree domain - language - source. At every node the children share by weight; a child that
hasn't enough (its tokens times the most epochs) leaves its shortage to its siblings, and only what a whole subtree
can't use goes to the siblings of its ancestors. A leaf takes whole epochs, then of one more epoch, shuffled by a seed, the
longest run of first documents that fits.

The tree has a row per leaf and is planned with windows over these few rows. Documents are never gathered by leaf: sums by
leaf and hash range find the range where a leaf's budget ends, only that range is sorted, and a last pass compares each
document's hash with its leaf's last one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovex.llm.shared import Shelf, col, fresh

LEVELS = ("domain", "lang", "source")
#: Leaves up to this number are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 100_000
#: What stands for a null at a level of the tree.
NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """weights: by level, of the children named; others have weight 1. Only the ratios among the siblings that occur count.
    budget: tokens to draw, as a share of those there. epochs: most times that a document is drawn."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=lambda: MappingProxyType({"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 11, "de": 3, "fr": 3, "es": 3}, "source": {}}))
    budget: float = 1.0
    epochs: int = 3
    seed: int = 17

    def weight(self, level: str) -> Column:
        pairs = [x for k, v in self.weights.get(level, {}).items() for x in (F.lit(k), F.lit(int(v)))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1)) if pairs else F.lit(1)


def tokens_of(text: Column) -> Column:
    """Tokens of a text, estimated at four bytes each and rounded up; none for a null."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(4)).cast("bigint"), F.lit(0).cast("bigint"))


def domain_of(source: Column) -> Column:
    """Domain of a source: the number at its end modulo 4; d0 where there is none."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0)) % 4).cast("int").cast("string"))


def _level(nodes: DataFrame, parents: list[str], name: str, mix: Mix) -> DataFrame:
    """nodes(parents, name, cap, pot) with got: each sibling's share of pot, in one step from the order of cap / weight."""
    nodes = nodes.withColumn("w", mix.weight(name).cast("double"))
    among = Window.partitionBy(*(parents or [F.lit(0)]))
    order = among.orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    nodes = nodes.withColumn("rise", (F.col("pot") - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    nodes = nodes.withColumn("line", F.max(F.when(F.col("cap") / F.col("w") > F.col("rise"), F.col("rise"))).over(among))
    return nodes.withColumn("got", F.when(F.col("line").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("line") * F.col("w")))).drop("rise", "line", "w")


def budgets(leaves: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Of leaves(domain, lang, source, tokens): full (whole epochs) and rest (tokens of one more epoch) beside."""
    leaves = leaves.withColumn("cap", F.col("tokens").cast("double") * mix.epochs)
    pot = leaves.agg(F.floor(F.sum("tokens") * F.lit(float(mix.budget))).cast("double").alias("pot"))
    parents: list[str] = []
    for name in LEVELS:
        nodes = leaves.groupBy(*parents, name).agg(F.sum("cap").alias("cap"))
        nodes = nodes.crossJoin(pot) if not parents else nodes.join(pot, parents)
        parents = [*parents, name]
        pot = _level(nodes, parents[:-1], name, mix).select(*parents, F.col("got").alias("pot"))
    got = F.floor("pot").cast("bigint")
    out = leaves.join(pot, list(LEVELS)).withColumn("full", F.floor(got / F.col("tokens")).cast("int"))
    return out.select(*LEVELS, "tokens", got.alias("budget"), "full", (got - F.col("full") * F.col("tokens")).alias("rest"))


def _shuffled(mix: Mix, epoch: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))


def drawn(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", domain: str | None = None, tokens: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(docs with columns added, their names by domain, lang, source, tokens, epochs): the documents that are drawn, epochs times each.

    domain and tokens name columns of the documents' domain and number of tokens; without them the domain is read off the
    source and tokens are estimated from the text. Nulls of domain, lang and source are nodes "(none)"; a null identifier is hashed as an empty one. Documents without
    a token aren't drawn. Documents of a leaf with equal hashes (repeated identifiers) are drawn together or not at all,
    so that the last epoch never exceeds its rest. Weights are positive whole numbers. An empty table stays empty.
    """
    names = dict(zip([*LEVELS, "tokens", "epochs", "seal", "full", "rest", "cut"], fresh(docs, "domain_node", "lang_node", "source_node", "tokens", "epochs", "seal", "full", "rest", "cut")))
    at = lambda k: F.col(names[k])
    tree = {
        names["domain"]: F.coalesce(col(docs, domain).cast("string"), F.lit(NONE)) if domain else domain_of(F.coalesce(col(docs, "source").cast("string"), F.lit(""))),
        names["lang"]: F.coalesce(col(docs, "lang").cast("string"), F.lit(NONE)),
        names["source"]: F.coalesce(col(docs, "source").cast("string"), F.lit(NONE)),
        names["tokens"]: F.coalesce(col(docs, tokens).cast("bigint"), F.lit(0).cast("bigint")) if tokens else tokens_of(col(docs, text).cast("string")),
    }
    docs = docs.withColumns(tree).where(at("tokens") > 0)
    shelf = Shelf(docs.sparkSession)
    slim = shelf.keep(docs.select(*[at(k).alias(k) for k in (*LEVELS, "tokens")], col(docs, id).alias("id")))
    plan = shelf.keep(budgets(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), mix).select(*LEVELS, "full", "rest"))
    few = plan.count() <= BROADCAST_LEAVES
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)

    hashed = slim.join(near(plan), list(LEVELS)).withColumn("seal", _shuffled(mix, F.col("full") + 1, F.col("id"))).withColumn("range", F.left("seal", F.lit(3)))
    ranges = hashed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("here"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("range")
    last = ranges.withColumn("upto", F.sum("here").over(upto)).where("upto > rest and upto - here <= rest").select(*LEVELS, "range", (F.col("upto") - F.col("here")).alias("before"))
    last = shelf.keep(last)
    within = hashed.join(near(last), [*LEVELS, "range"])
    within = within.withColumn("sum", F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("seal").rangeBetween(Window.unboundedPreceding, 0)))
    ends = within.where("sum <= rest").groupBy(*LEVELS).agg(F.max("seal").alias("end"))
    plan = plan.join(last, list(LEVELS)).join(ends, list(LEVELS), "left").select(*[F.col(k).alias(names[k]) for k in LEVELS], F.col("full").alias(names["full"]), F.coalesce("end", "range").alias(names["cut"]))
    plan = shelf.keep(plan)

    out = docs.join(near(plan), [names[k] for k in LEVELS])
    out = out.withColumn(names["epochs"], at("full") + (_shuffled(mix, at("full") + 1, col(out, id)) <= at("cut")).cast("int")).where(at("epochs") > 0)
    return out.drop(names["full"], names["cut"]), {k: names[k] for k in (*LEVELS, "tokens", "epochs")}


def mixture(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", domain: str | None = None, tokens: str | None = None) -> DataFrame:
    """(id, domain, lang, source, tokens, epochs) of every document drawn; see drawn."""
    out, names = drawn(docs, mix, id, text, domain, tokens)
    return out.select(col(out, id).alias(id), *[F.col(v).alias(k) for k, v in names.items()])


def mixed(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", domain: str | None = None, tokens: str | None = None) -> DataFrame:
    """docs as drawn: a row for every epoch that a document is in, all columns as they were; see drawn."""
    out, names = drawn(docs, mix, id, text, domain, tokens)
    (again,) = fresh(out, "again")
    return out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(names["epochs"])))).select(*[col(out, c) for c in docs.columns])


def _weights_sql(mix: Mix, level: str) -> str:
    cases = "".join(f" WHEN {level} = '{k}' THEN {int(v)}" for k, v in mix.weights.get(level, {}).items())
    return f"(CASE{cases} ELSE 1 END)::DOUBLE" if cases else "1::DOUBLE"


def sql(mix: Mix = Mix()) -> str:
    """DuckDB's way to the rows of mixture."""
    parts = [
        f"""docs AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 4) AS domain,
            coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, ceil(octet_length(encode(text)) / 4.0)::BIGINT AS tokens FROM documents WHERE text <> '')""",
        f"leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * {mix.epochs} AS cap FROM docs GROUP BY ALL)",
        f"pot0 AS (SELECT floor(sum(tokens)::DOUBLE * {float(mix.budget)}) AS pot FROM leaves)",
    ]
    parents: list[str] = []
    for n, level in enumerate(LEVELS, 1):
        keys = ", ".join([*parents, level])
        among = f"PARTITION BY {', '.join(parents)}" if parents else ""
        join = f"JOIN pot{n - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN pot0"
        parts += [
            f"n{n} AS (SELECT *, {_weights_sql(mix, level)} AS w FROM (SELECT {keys}, sum(cap) AS cap FROM leaves GROUP BY ALL) {join})",
            f"""r{n} AS (SELECT *, (pot - coalesce(sum(cap) OVER ({among} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER ({among} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise FROM n{n})""",
            f"l{n} AS (SELECT *, max(CASE WHEN cap / w > rise THEN rise END) OVER ({among}) AS line FROM r{n})",
            f"pot{n} AS (SELECT {keys}, CASE WHEN line IS NULL THEN cap ELSE least(cap, line * w) END AS pot FROM l{n})",
        ]
        parents.append(level)
    parts += [
        "plan AS (SELECT domain, lang, source, floor(pot)::BIGINT // tokens AS full_epochs, floor(pot)::BIGINT % tokens AS rest FROM leaves JOIN pot3 USING (domain, lang, source))",
        f"seals AS (SELECT *, md5('{mix.seed}:' || (full_epochs + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS seal FROM docs JOIN plan USING (domain, lang, source))",
        "sums AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY seal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM seals)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, tokens, (full_epochs + (upto <= rest)::INT)::INT AS epochs FROM sums WHERE full_epochs + (upto <= rest)::INT > 0"
