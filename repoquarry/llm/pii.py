"""Personal data in texts: known formats, and the terms that give them away.

Known formats (emails, IP addresses, card numbers, phone numbers) are found by expressions,
leftmost and without overlap for each kind; a match that fails its check (parts above 255,
the Luhn sum, the number of digits) is dropped and not tried again shorter.

Beyond them the corpus decides. Each found value is a protected entity. Terms (runs of
letters, lower-cased) within WINDOW terms of an entity co-occur with it. Over all documents,
c(t, e) counts those where t stands near e and df(t) those holding t at all; then
c(t, e) / df(t) estimates P(e | t), how much seeing t tells about e. A term whose posterior
for some entity reaches MIN_POSTERIOR, seen with it in MIN_DOCS documents or more, discloses
that entity: every occurrence of it becomes a span of kind `quasi`, and `sanitise`
generalises it to a placeholder, as it does with the entities themselves.

All statistics are sums over all documents (Spark aggregations; partial sums before every
shuffle, so a value or term found in a third of all documents is a bounded task). The
disclosing terms go to the tasks as a set when their size is within BROADCAST_BYTES; beyond
that, each document gets its own list by a join.

Defined cases: a null text is an empty text, without spans. Spans are in code points, end
exclusive. Very long texts cost time linear in their length. Repeated rows and repeated
entities count once per document in the statistics and get equal answers. Rows with a null
id take part and keep it. An empty table gives an empty result. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoquarry.llm.common import slices
from repoquarry.session import materialise

# Fixed values of the contract: kinds in order, and their expressions.
KINDS = ("email", "ip", "card", "phone", "quasi")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW = 5  # terms on each side of an entity that stand near it
MIN_DOCS = 2  # documents in which a term must stand near the entity
MIN_POSTERIOR = 0.5  # least estimate of P(entity | term) that discloses
BROADCAST_BYTES = 32 << 20  # largest set of disclosing terms sent to every task

_TERM = re.compile(r"[^\W\d_]{3,}")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "quasi": "[TERM]"}


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _valid(kind: int, value: str) -> bool:
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        d = _digits(value)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 9 <= len(_digits(value)) <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known formats, by start then kind."""
    found = []
    for kind, pattern in enumerate((_EMAIL, _IP, _CARD, _PHONE)):
        for m in pattern.finditer(text):
            if _valid(kind, m.group()):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value of a span: emails in lower case, numbers by their digits."""
    start, kind, end = span
    value = text[start:end]
    if kind == 0:
        return "email:" + value.lower()
    if kind in (2, 3):
        return f"{KINDS[kind]}:" + _digits(value)
    return f"{KINDS[kind]}:" + value


def terms(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms that meet no span of a known format, in order."""
    covered: list[list[int]] = []
    for a, _, b in sorted(base):
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    kept = []
    for m in _TERM.finditer(text):
        a, b = m.span()
        i = bisect.bisect_right(starts, a) - 1
        if (i >= 0 and covered[i][1] > a) or (i + 1 < len(covered) and covered[i + 1][0] < b):
            continue
        kept.append((a, b, m.group().lower()))
    return kept


def near(text: str) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """The distinct terms of a text, and each distinct entity with the distinct terms
    within WINDOW terms of one of its occurrences."""
    base = base_spans(text)
    found = terms(text, base)
    starts = [a for a, _, _ in found]
    nearby: dict[str, set[str]] = {}
    for span in base:
        before = bisect.bisect_left(starts, span[0])
        after = bisect.bisect_left(starts, span[2])
        around = found[max(0, before - WINDOW) : before] + found[after : after + WINDOW]
        nearby.setdefault(entity(text, span), set()).update(t for _, _, t in around)
    return sorted({t for _, _, t in found}), [(e, sorted(ts)) for e, ts in sorted(nearby.items())]


def scan(text: str, disclosing) -> tuple[list[int], list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Counts of the four known kinds, their spans, and all spans with the terms that
    disclose (any term in `disclosing`)."""
    base = base_spans(text)
    more = [(a, 4, b) for a, b, t in terms(text, base) if t in disclosing]
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    return counts, base, sorted(base + more)


def named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def sanitised(text: str, spans) -> str:
    """The text with each span (outermost first) replaced by its placeholder."""
    out, at = [], 0
    for a, k, b in spans:
        if a < at:
            continue
        out += [text[at:a], PLACEHOLDER[KINDS[k]]]
        at = b
    return "".join(out + [text[at:]])


def _nearby(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [near(t.as_py() or "") for t in batch.column(1)]
        terms_ = pa.array([f[0] for f in found], pa.list_(pa.string()))
        kind = pa.list_(pa.struct([("e", pa.string()), ("t", pa.list_(pa.string()))]))
        entities = pa.array([[{"e": e, "t": ts} for e, ts in f[1]] for f in found], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), terms_, entities], ["_k", "_terms", "_entities"])


def statistics(docs: DataFrame, key: str = "_k", text: str = "text") -> DataFrame:
    """(_k, _terms, _entities): each row's distinct terms, and its entities with their near
    terms. Written once, both the sums and each row's own list come from it."""
    slim = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    schema = f"_k {kind}, _terms array<string>, _entities array<struct<e:string, t:array<string>>>"
    return slim.mapInArrow(_nearby, schema)


def disclosing_terms(near_: DataFrame) -> DataFrame:
    """(term, entity, posterior, n_near, df): for each disclosing term the entity it gives
    away most (ties: more documents, then the smallest entity), from the statistics of all
    rows of `near_` (as `statistics` makes them)."""
    df = near_.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pairs = near_.select(F.explode("_entities").alias("_x")).select(
        F.col("_x.e").alias("entity"), F.explode("_x.t").alias("term")
    )
    counted = pairs.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_near"))
    counted = counted.where(F.col("n_near") >= MIN_DOCS)
    scored = counted.join(df, "term").withColumn("posterior", F.col("n_near") / F.col("df"))
    scored = scored.where(F.col("posterior") >= MIN_POSTERIOR)
    rank = F.struct(
        (-F.col("posterior")).alias("p"), (-F.col("n_near")).alias("n"), F.col("entity").alias("e"), F.col("df").alias("df")
    )
    best = scored.groupBy("term").agg(F.min(rank).alias("_b"))
    return best.select(
        "term", F.col("_b.e").alias("entity"), (-F.col("_b.p")).alias("posterior"),
        (-F.col("_b.n")).alias("n_near"), F.col("_b.df").alias("df"),
    )


_FIELDS = (
    ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()), ("sanitised", pa.string()),
)


def _scanned(shared: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            own = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for t, mine in zip(batch.column(1), own):
                text = t.as_py() or ""
                disclosing = shared | set(mine) if mine else shared
                counts, base, spans = scan(text, disclosing)
                digest = hashlib.sha256(named(base).encode()).hexdigest()
                rows.append((*counts, digest, named(spans), sanitised(text, spans)))
            columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _FIELDS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], ["_id", *[name for name, _ in _FIELDS]]
            )

    return run


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, sanitised) for every row."""
    slim = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = slim.schema[0].dataType.simpleString()
    schema = (
        f"_id {kind}, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, sanitised string"
    )
    keyed = slim.withColumn("_k", F.xxhash64("_id", "_text"))
    near_ = materialise(statistics(keyed, "_k", "_text"), "pii-near")
    found = materialise(disclosing_terms(near_).select("term"), "pii-terms")
    size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term") + 64), F.lit(0))).first()
    if size[1] <= BROADCAST_BYTES:
        shared = frozenset(r.term for r in found.collect())
        return slim.mapInArrow(_scanned(shared), schema).withColumnRenamed("_id", id)
    # Too many to send to every task: each row gets the disclosing terms it holds.
    held = near_.select("_k", F.explode("_terms").alias("term")).join(found, "term")
    mine = held.groupBy("_k").agg(F.collect_set("term").alias("_mine"))
    joined = keyed.join(mine, "_k", "left").select("_id", "_text", "_mine")
    return joined.mapInArrow(_scanned(frozenset()), schema).withColumnRenamed("_id", id)
