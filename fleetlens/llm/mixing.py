"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed over cells (source, language, topic). Raking multiplies the tokens to draw from each cell in turn so that their sums
over each source, language and topic reach the targets; no cell gives more than it has, so where one is full the next
factors raise the others. The total is the wanted one, or less where a category has too few tokens for its target, and
is lowered further until all marginals hold. Where no cell was asked for more than it has, a lower total only scales the draw: targets
that don't hold then hold at no lower total, and the largest total that comes about as near to them as any is kept. A document of a
cell is drawn with the cell's share of tokens to draw. The draw is a function of the doc_id, so that a rerun draws the same
documents. Cells and marginals are tables of their own, whose size depends on the number of categories only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join, text_or_empty

DIMS = ("source", "lang", "topic")
ROUNDS = 12
NEAR = 0.01  # relative difference from a target that is accepted
ROOM = 0.95  # of the tokens of the category that is scarcest against its target
LESS = 0.8  # the total is lowered to this while a marginal is missed
#: Temperature of each target: shares grow as the tokens to this power.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP = 0.8  # share of all tokens that is drawn
NONE = "(none)"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def form_topic(text: Column, n_words: Column) -> Column:
    """A topic by form, for corpora without a topic column: empty, table, shouting, signs, short, long or prose."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (F.when(n_words == 0, "empty").when(count("\\|") * 4 >= n_words, "table").when(count("!!") * 4 >= n_words, "shouting")
            .when(count("[#$%&*]{3}") * 4 >= n_words, "signs").when(n_words < 60, "short").when(n_words >= 1500, "long").otherwise("prose"))


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of a dimension: proportional to its tokens to a power."""
    t = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("t", F.pow(F.col("t").cast("double"), F.lit(power)))
    return t.select(dim, (F.col("t") / F.lit(t.agg(F.sum("t")).first()[0] or 1.0)).alias("target"))


def rake(tmp: Scratch, cells: DataFrame, targets: dict[str, DataFrame], total: float, rounds: int = ROUNDS) -> DataFrame:
    """Cells with ``w``, the tokens to draw: at most the cell's, summing to about ``total`` times the target in each category.

    Categories without tokens can give none: their target is left out and the others' shares hold among themselves.
    A category that has tokens but no target gives none. Each factor's cells are a table of their own: a plan with the three
    factors of a round holds the first one four times, and the driver keeps a broadcast for each. The targets stay beside
    the cells, as ``t_`` and the dimension; ``cut`` tells whether a factor asked a cell for more than it has.
    """
    have = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("w", F.col("tokens") * F.lit(total / have)).withColumn("cut", F.lit(False))
    for dim, target in targets.items():
        now = hot_join(now, target.select(dim, F.col("target").alias(f"t_{dim}")), [dim]).fillna(0.0, [f"t_{dim}"])
    now = tmp.keep(now, "cells")
    for _ in range(rounds):
        for dim in targets:
            factor = now.groupBy(dim).agg(F.sum("w").alias("s"), F.max(f"t_{dim}").alias("t"))
            factor = factor.select(dim, F.when(F.col("s") > 0, F.col("t") * F.lit(total) / F.col("s")).otherwise(F.lit(0.0)).alias("f"))
            most, asked = F.col("tokens").cast("double"), F.col("w") * F.col("f")
            step = hot_join(now, factor, [dim], "inner").withColumns({"w": F.least(most, asked), "cut": F.col("cut") | F.coalesce(asked > most, F.lit(False))}).drop("f")
            nxt = tmp.keep(step, "cells")
            tmp.drop(now)
            now = nxt
    return now


def missed(raked: DataFrame, dims: Iterable[str], total: float) -> tuple[float, bool]:
    """The largest relative difference of a category's sum from its target, and whether a cell was asked for more than it has."""
    far, cut = 0.0, False
    for dim in dims:
        sums = raked.groupBy(dim).agg(F.sum("w").alias("s"), F.max(f"t_{dim}").alias("t"), F.max("cut").alias("cut"))
        most, some = sums.agg(F.max(F.when(F.col("t") > 0, F.abs(F.col("s") / (F.col("t") * total) - 1))), F.max("cut")).first()
        far, cut = max(far, most or 0.0), cut or bool(some)
    return far, cut


def mix(docs: DataFrame, n_tokens: Column | None = None, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, rounds: int = ROUNDS,
        carry: tuple[str, ...] = (), tmp: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, source, lang, ...)``: doc_id, source, lang, topic, n_tokens, weight,
    probability, sampled, and the columns of ``carry``.

    ``weight`` is the cell's share of the tokens to draw, ``probability`` that of drawing the row; expected sums over each
    source, language and topic are within 1 % of the targets, if any total allows that. At most the share ``keep`` of all tokens is drawn, less where the targets need it. ``targets`` has a table
    (category, target) per dimension, shares summing to 1; default: tempered shares of the corpus itself. Null source,
    language or topic form the category "(none)"; null text counts as empty. Rows without tokens have no weight and are
    not drawn. Equal doc_ids (all null ones, too) are drawn together. Extra columns are ignored; empty gives empty.
    """
    spark = docs.sparkSession
    tmp = tmp or Scratch(spark)
    text = text_or_empty()
    n = words(text) if n_tokens is None else n_tokens
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    own = next(c for c in ("_n", *(f"_n{i}" for i in range(len(docs.columns) + 1))) if c not in docs.columns)
    base = docs.withColumn(own, n.cast("long"))
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), name("source"), name("lang"),
                       F.coalesce((form_topic(text, F.col(own)) if topic is None else topic).cast("string"), F.lit(NONE)).alias("topic"), F.col(own).alias("n_tokens"), *carry)
    slim = tmp.keep(rows.drop(*carry), "rows") if not carry else rows
    cells = tmp.keep(slim.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if targets is None:
        targets = {d: tmp.keep(tempered(cells, d, POWERS[d]), f"target-{d}") for d in DIMS}
    sums = {d: cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0") for d in DIMS}
    # targets among the categories that have tokens
    present = {d: sums[d].join(targets[d], d).where("target > 0").select(d, "t", "target") for d in DIMS}
    whole = {d: present[d].agg(F.sum("target")).first()[0] for d in DIMS}
    present = {d: tmp.keep(present[d].withColumn("target", F.col("target") / F.lit(whole[d] or 1.0)), f"target-{d}") for d in DIMS}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scarce = min((present[d].agg(F.min(F.col("t") / F.col("target"))).first()[0] or 0.0) for d in DIMS)
    wanted = min(keep * total, ROOM * scarce)
    targets = {d: t.drop("t") for d, t in present.items()}
    tried = []
    while True:
        raked = rake(tmp, cells, targets, wanted, rounds)
        far, cut = missed(raked, targets, wanted)
        tried.append((far, wanted, raked))
        if far <= NEAR or not cut or wanted * LESS < 1:
            break
        wanted *= LESS
    if far > NEAR:  # no total holds: the largest one that comes about as near as any
        least = min(far for far, _, _ in tried)
        _, wanted, raked = next(t for t in tried if t[0] <= least + NEAR)
    p = raked.select(*DIMS, (F.col("w") / F.lit(wanted or 1.0)).alias("weight"), F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0)).alias("p"))
    p = tmp.keep(p, "probabilities")
    out = hot_join(slim, p, DIMS)
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return out.select("doc_id", *DIMS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("p", 9).alias("probability"), (draw < F.col("p")).alias("sampled"), *carry)


def oracle(rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in SQL: one CTE for each factor of each round."""
    w = "[\\x20\\x09-\\x0D]"
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    q = [f"""d as (select doc_id, coalesce(source, '{NONE}') as source, coalesce(lang, '{NONE}') as lang, coalesce(text, '') as text,
        len(regexp_extract_all(coalesce(text, ''), '{w.replace('[', '[^')}+')) as n_tokens from documents)""",
         f"""r as materialized (select doc_id, source, lang, n_tokens, case when n_tokens = 0 then 'empty' when {count('\\|')} * 4 >= n_tokens then 'table'
        when {count('!!')} * 4 >= n_tokens then 'shouting' when {count('[#$%&*]{3}')} * 4 >= n_tokens then 'signs' when n_tokens < 60 then 'short'
        when n_tokens >= 1500 then 'long' else 'prose' end as topic from d)""",
         "c as materialized (select source, lang, topic, cast(sum(n_tokens) as bigint) as tokens from r group by all)"]
    for d in DIMS:
        q.append(f"t_{d} as materialized (select {d}, p / sum(p) over () as target from (select {d}, pow(cast(sum(tokens) as double), {POWERS[d]}) as p from c group by {d} having sum(tokens) > 0))")
    q.append(f"n as materialized (select least({keep} * (select sum(tokens) from c), {ROOM} * least({', '.join(f'(select min(t / target) from (select {d}, sum(tokens) as t from c group by {d}) join t_{d} using ({d}))' for d in DIMS)})) as total)")
    q.append("w0 as materialized (select c.*, tokens * (total / greatest(sum(tokens) over (), 1)) as w from c, n)")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            q.append(f"w{k + 1} as materialized (select x.source, x.lang, x.topic, x.tokens, least(x.tokens, x.w * case when s > 0 then coalesce(target, 0) * total / s else 0 end) as w from n, w{k} x "
                     f"join (select {d}, sum(w) as s from w{k} group by {d}) m on x.{d} = m.{d} left join t_{d} t on x.{d} = t.{d})")
            k += 1
    q.append(f"p as materialized (select source, lang, topic, w / total as w, case when tokens > 0 then w / tokens else 0.0 end as p from w{k}, n)")
    return (f"with {', '.join(q)} select doc_id, r.source, r.lang, r.topic, cast(n_tokens as bigint) as n_tokens, round(w, 9) as weight, round(p, 9) as probability, "
            "cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) / 281474976710656.0 < p as sampled from r join p on r.source = p.source and r.lang = p.lang and r.topic = p.topic")
