"""Secret scan with corpus-wide ownership frequency.

Each text is scanned where it lies. Assignments, access keys and long hex runs
(the base kinds) are always reported. Further candidates (vendor tokens, signed
web tokens, private keys, passwords in URLs, opaque mixed runs) are reported
only if they look live: the digest of the candidate's value is counted over the
whole corpus by distinct owners and by distinct repositories, and a value that
few owners and repositories hold is taken as a credential of theirs, one that
many hold as a copied example. Base spans are counted the same way and carry
the verdict too (``n_live``, ``n_copied``).

Only digests travel. Owners and repositories are counted in three partial
aggregates, (value, owner, repository), (value, owner), (value), so a value
that a third of all rows hold is spread over its repositories first; the join
back is between two written tables, whose hot partitions Spark can split.

Defined results: a null text is empty; a null owner or identifier counts as one
owner or repository of its own; repeated rows are rows of their own in one
repository; an empty table gives an empty result. Spans are code points, end
exclusive. A further candidate that overlaps a base span or an earlier
candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

BASE_KINDS = ("assign", "access", "hex")
FURTHER_KINDS = ("pem", "jwt", "vendor", "url", "opaque")
#: A value held by more owners, or in more repositories, is a copied example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 8
#: An opaque run is a candidate from this entropy (bits a character) on.
OPAQUE_BITS = 3.5

# The patterns of the base kinds, least lengths, and published token formats.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"                                 # a run of 16 or more
HEX = r"[0-9a-f]{32,}"
PEM = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,30}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
VENDOR = (r"gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}"
          r"|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}")
URL = r"://[^\s/:@]{1,64}:([^\s/:@]{6,64})@"
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"


def make_scanner():
    """text -> base and further candidates as ``(kind, start, end, value)``."""
    import math
    import re
    from collections import Counter
    assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
    words = ("password", "passwd", "secret", "token", "api")
    rest = {"access": re.compile(ACCESS), "hex": re.compile(HEX)}
    further = {"pem": re.compile(PEM), "jwt": re.compile(JWT), "vendor": re.compile(VENDOR), "url": re.compile(URL)}
    opaque = re.compile(OPAQUE)

    def is_opaque(value: str) -> bool:
        """Digits and letters mixed, and no word, path or repeated filling."""
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            return False
        n = len(value)
        return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= OPAQUE_BITS

    def scan(text: str) -> tuple[list, list]:
        base = []
        low = text.lower()
        if any(w in low for w in words):
            base += [("assign", m.start(), m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        for kind, pattern in rest.items():
            base += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
        taken = sorted((s, e) for _, s, e, _ in base)
        more = []
        for kind, pattern in further.items():
            more += [(kind, m.start(), m.end(), m[pattern.groups]) for m in pattern.finditer(text)]
        more += [("opaque", m.start(), m.end(), m[0]) for m in opaque.finditer(text) if is_opaque(m[0])]
        return base, _free(more, taken)

    return scan


def _free(found: list, base: list) -> list:
    """Candidates, stronger kinds first, that overlap no base span and none kept before."""
    from bisect import bisect_left, insort
    taken: list[tuple[int, int]] = []                         # disjoint, by start
    for start, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    out = []
    for kind, start, end, value in found:
        at = bisect_left(taken, (end, 0))                     # all before it start before this end
        if not at or taken[at - 1][1] <= start:
            insort(taken, (start, end))
            out.append((kind, start, end, value))
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repository_col: str) -> DataFrame:
    """Staged, one row per document: its identifier, owner and repository, the
    base spans as text, and all candidates with the digest of their value."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext
        scan = make_scanner()
        row_key = TaskContext.get().partitionId() << 33
        order = {k: i for i, k in enumerate(BASE_KINDS + FURTHER_KINDS)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                                   ("base", pa.bool_()), ("digest", pa.binary())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                out = [[] for _ in range(6)]
                for text in rows.column(3).to_pylist():
                    base, more = scan(text or "")
                    spans = sorted([(s, order[k], e, True, v) for k, s, e, v in base] + [(s, order[k], e, False, v) for k, s, e, v in more])
                    kinds = list(order)
                    found = [{"kind": kinds[k], "start": s, "stop": e, "base": b,
                              "digest": hashlib.blake2b(v.encode(), digest_size=16).digest()} for s, k, e, b, v in spans]
                    out[0].append(row_key)
                    out[1].append(",".join(f"{f['kind']}:{f['start']}:{f['stop']}" for f in found if f["base"]))
                    for column, name in zip(out[2:5], BASE_KINDS):
                        column.append(sum(k == name for k, *_ in base))
                    out[5].append(found)
                    row_key += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), rows.column(0), rows.column(1), rows.column(2), pa.array(out[1], pa.string()),
                     *[pa.array(c, pa.int64()) for c in out[2:5]], pa.array(out[5], kind)],
                    names=["row_key", "id", "owner", "repository", "base", "n_assign", "n_access", "n_hex", "found"])

    schema = f"row_key long, id {docs.schema[id_col].dataType.simpleString()}, " \
             "owner string, repository string, base string, n_assign long, n_access long, n_hex long, " \
             "found array<struct<kind: string, start: int, stop: int, base: boolean, digest: binary>>"
    plain = docs.select(docs[id_col].alias("id"), docs[owner_col].cast("string").alias("owner"),
                        docs[repository_col].cast("string").alias("repository"), docs[text_col].cast("string").alias("text"))
    return stage(plain.mapInArrow(run, schema), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_owners, n_repositories`` from rows of ``digest, owner,
    repository``; a repository belongs to its owner."""
    each = found.groupBy("digest", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("digest", "owner").agg(F.sum("one").alias("held"))
    return by_owner.groupBy("digest").agg(F.count("*").alias("n_owners"), F.sum("held").alias("n_repositories"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document: ``id_col, n_assign, n_access, n_hex, base`` (base
    spans as ``kind:start:end``, by start), ``spans`` (base and added ones),
    ``n_live``, ``n_copied`` (candidates by verdict), and ``found``, all
    candidates with owners, repositories and verdict."""
    rows = candidates(docs, id_col, text_col, owner_col, repository_col)
    single = rows.select("row_key", "owner", "repository", F.posexplode("found").alias("pos", "c"))
    single = single.select("row_key", "owner", "repository", "pos", F.col("c.digest").alias("digest"))
    held = stage(ownership(single), "secret-owners")
    verdicts = (single.join(held, "digest").groupBy("row_key")
                .agg(F.array_sort(F.collect_list(F.struct("pos", "n_owners", "n_repositories"))).alias("v")))   # a text bounds its own
    judged = F.zip_with("found", "v", lambda c, v: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"),
        v["n_owners"].alias("n_owners"), v["n_repositories"].alias("n_repositories"),
        ((v["n_owners"] <= max_owners) & (v["n_repositories"] <= max_repositories)).alias("live")))
    out = (rows.join(verdicts, "row_key", "left")
           .withColumn("v", F.coalesce("v", F.array().cast("array<struct<pos: int, n_owners: long, n_repositories: long>>")))
           .withColumn("found", judged))
    text = F.transform(F.filter("found", lambda c: c["base"] | c["live"]),
                       lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string")))
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base", F.array_join(text, ",").alias("spans"),
                      F.size(F.filter("found", lambda c: c["live"])).cast("long").alias("n_live"),
                      F.size(F.filter("found", lambda c: ~c["live"])).cast("long").alias("n_copied"), "found")
