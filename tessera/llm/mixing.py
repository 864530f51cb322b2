"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target share x rows wanted / rows it
has. A document's number of copies is the inverse Poisson distribution of its
source at a uniform number taken from a seeded hash of its identifier and its
text's digest, so a run can be repeated, no row depends on another, and rows
without an identifier draw for themselves. Copies are exploded and put in a
global random order by range-partitioning a second seeded hash; a row's place
in its input breaks ties there, so even a text that a third of all rows repeat
under one identifier spreads over the ranges.

``targets`` (source -> weight) is a parameter; every source outside it, null
included, belongs to one remaining group with ``rest_weight``. The rate table
therefore has at most ``len(targets) + 1`` rows, which bounds its broadcast;
counting rows per source is partial in the map tasks, so a hot source costs no
more than another. Weights are scaled over the groups that have rows.

Defined results: a null identifier hashes as an empty one, a null text as an
empty one; rows equal in identifier and text get equal counts and equal shuffle
keys; an empty table gives an empty result; a group of weight zero gives no
rows; a column of ``docs`` named like an added one is kept as ``doc_<name>``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REST = ""
SEED = "mix-1"


def hash_unit(*parts: Column) -> Column:
    """Uniform double in [0, 1) with 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def _group(source: Column, targets: Mapping[str, float]) -> Column:
    return F.when(source.isin(*targets), source).otherwise(F.lit(REST)) if targets else F.lit(REST)


def poisson_cdf(rate: Column) -> Column:
    """Array of P(count <= k) for k = 0, 1, ... to far beyond double precision."""
    first = F.struct(F.lit(0.0).alias("log_factorial"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state, k):
        log_factorial = state["log_factorial"] + F.log(k.cast("double"))
        total = state["sum"] + F.exp(-rate + k * F.log(rate) - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("sum"),
                        F.concat(state["cdf"], F.array(total)).alias("cdf"))

    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    return F.aggregate(F.sequence(F.lit(1), top), first, step, lambda s: s["cdf"])


def mixing_rates(docs: DataFrame, targets: Mapping[str, float], rest_weight: float = 0.0, epochs: float = 1.0,
                 source_col: str = "source") -> DataFrame:
    """``grp, n_docs, rate``: mean copies of a document of each group so that
    the mix has ``epochs`` times the input's rows in the target shares."""
    weight = F.lit(float(rest_weight))
    for name, share in targets.items():
        weight = F.when(F.col("grp") == name, F.lit(float(share))).otherwise(weight)
    counts = (docs.groupBy(_group(docs[source_col], targets).alias("grp")).agg(F.count("*").alias("n_docs"))
              .withColumn("weight", weight))
    whole = Window.partitionBy(F.lit(1))                     # at most len(targets) + 1 rows
    share = F.col("weight") / F.sum("weight").over(whole)
    return counts.select("grp", "n_docs", (share * F.lit(float(epochs)) * F.sum("n_docs").over(whole)
                                           / F.col("n_docs")).alias("rate"))


ADDED = ("mix_rate", "copy_no", "shuffle_key")


def _kept_name(name: str, taken: set[str]) -> str:
    while name.lower() in taken:
        name = f"doc_{name}"
    return name


def mix_to_weights(docs: DataFrame, targets: Mapping[str, float], rest_weight: float = 0.0, epochs: float = 1.0,
                   seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                   with_draws: bool = True) -> DataFrame:
    """Every column of ``docs``, one row per copy, globally ordered by a seeded
    hash; ``with_draws`` adds ``mix_rate``, ``copy_no`` (1, 2, ...) and that
    hash, ``shuffle_key``."""
    rates = (mixing_rates(docs, targets, rest_weight, epochs, source_col).filter("rate > 0")
             .select("grp", F.col("rate").alias("mix_rate"), poisson_cdf(F.col("rate")).alias("cdf")))
    own = [F.coalesce(docs[id_col].cast("string"), F.lit("")), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))]
    drawn = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _group(docs[source_col], targets).alias("grp"),
                        F.concat_ws(":", *own).alias("own"), hash_unit(F.lit(seed), *own).alias("u"))   # before the join: once a row
    copies = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    out = (drawn.join(F.broadcast(rates), "grp").withColumn("copies", copies).filter("copies > 0")
           .select("row", "mix_rate", "own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
           .select("row", "mix_rate", "copy_no", F.conv(F.substring(F.md5(F.concat_ws(
               ":", F.lit(seed), "own", F.col("copy_no").cast("string"))), 1, 15), 16, 10).cast("long").alias("shuffle_key"),
               F.monotonically_increasing_id().alias("place")))
    out = out.repartitionByRange("shuffle_key", "place").sortWithinPartitions("shuffle_key", "place")
    if not with_draws:
        return out.select("row.*")
    names, taken = [], set(ADDED)
    for c in docs.columns:
        names.append(_kept_name(c, taken))
        taken.add(names[-1].lower())
    return out.select(*[F.col("row").getField(c).alias(n) for c, n in zip(docs.columns, names)], *ADDED)


#: Production mix: the crawl-like large source at a tenth, two curated sources
#: raised, the others sharing what is left in proportion to their rows.
PRODUCTION_TARGETS = {"src0": 0.10, "src1": 0.10, "src2": 0.10}
PRODUCTION_REST = 0.70

ORACLE = f"""
WITH d AS (SELECT *, CASE WHEN source IN ('src0', 'src1', 'src2') THEN source ELSE '' END AS grp FROM documents),
c AS (SELECT grp, count(*) AS n_docs, CASE grp WHEN 'src0' THEN 0.10 WHEN 'src1' THEN 0.10 WHEN 'src2' THEN 0.10 ELSE 0.70 END::DOUBLE AS w
      FROM d GROUP BY grp),
r AS (SELECT grp, (w / sum(w) OVER ()) * sum(n_docs) OVER () / n_docs AS rate FROM c),
p AS (SELECT grp, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY grp ORDER BY k) AS cdf
      FROM r, range(0, 200) AS t(k)),
u AS (SELECT d.*, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, p.rate, count(*) FILTER (WHERE p.cdf <= u.u) AS n
      FROM u JOIN p ON u.grp = p.grp GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, copy_no::INTEGER AS copy_no,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || copy_no), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM n WHERE n > 0)
"""
