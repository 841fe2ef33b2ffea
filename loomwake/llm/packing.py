"""Filling fixed-capacity containers with whole documents, in controlled proportions of sources."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwake.session import cut

#: A public tokenizer's ranks; the place is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer parts a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens a shard holds on average; a shard is packed by one task.
TOKENS_PER_SHARD = 2_000_000
#: Containers' worth of tokens drawn from the sources at a time.
WINDOW = 64
#: Most packing limits that are taken.
LIMITS = 1000


@lru_cache(2)
def encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, keep: list[str], text: str, name: str = "n_tokens", path: str = TOKENIZER) -> DataFrame:
    """``keep`` and the number of tokens of ``text``; null and empty texts have none."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], [*keep, name])

    return docs.select(*keep, F.col(text).alias("__t")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"{name} long"]))


def draw(queues: dict[str, deque], share: dict[str, float], deficit: dict[str, float], room: int) -> list[tuple]:
    """The next items from the queues: about ``room`` tokens by deficit round-robin.

    Each source's credit grows by its share of the window and is spent by what is taken; credit
    that is left, or overdrawn, is carried on in ``deficit``. A source without items lends its
    credit to the others, so the queues always move.
    """
    out, total = [], 0
    live = [s for s in sorted(queues) if queues[s]]
    while live and total < room:
        weight = sum(share.get(s, 0.0) for s in live)
        left = room - total
        for s in live:
            deficit[s] = deficit.get(s, 0.0) + left * (share.get(s, 0.0) / weight if weight > 0 else 1 / len(live))
        moved = False
        for s in live:
            q = queues[s]
            while q and q[0][0] <= deficit[s] and total < room:
                item = q.popleft()
                deficit[s] -= item[0]
                total += item[0]
                out.append(item)
                moved = True
        live = [s for s in live if queues[s]]
        if not moved and live:  # every head is larger than its source's credit: the nearest goes first
            s = min(live, key=lambda x: (queues[x][0][0] - deficit[x], x))
            item = queues[s].popleft()
            deficit[s] -= item[0]
            total += item[0]
            out.append(item)
            live = [s for s in live if queues[s]]
    return out


class Containers:
    """Open containers by free space; each item goes where it leaves the least (best fit)."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, 0
        self.open: list[tuple[int, int]] = []

    def new(self) -> int:
        self.count += 1
        return self.count - 1

    def place(self, size: int) -> int:
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            free, c = self.open.pop(at)
        else:
            free, c = self.capacity, self.new()
        if free > size:
            insort(self.open, (free - size, c))
        return c


def pack_shard(items: list[tuple[int, str, object]], share: dict[str, float], carry: dict[str, float], capacity: int, window: int = WINDOW) -> tuple[list[tuple], dict[str, float]]:
    """Containers of one shard: (item, piece, start, size, container, window); and the deficits left.

    ``items`` are (tokens, source, key) in queue order. An item longer than ``capacity`` fills
    containers of its own with all but its last piece, which is packed like any other.
    """
    queues: dict[str, deque] = {}
    boxes, out = Containers(capacity), []
    for k, (n, source, _) in enumerate(items):
        queues.setdefault(source, deque()).append((n, k))
    deficit, turn = dict(carry), 0
    while any(queues.values()):
        drawn = draw(queues, share, deficit, capacity * window)
        rest = []
        for n, k in drawn:
            full = (n - 1) // capacity if n else 0
            for piece in range(full):
                out.append((k, piece, piece * capacity, capacity, boxes.new(), turn))
            rest.append((n - full * capacity, k, full))
        for size, k, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
            out.append((k, piece, piece * capacity, size, boxes.place(size), turn))
        turn += 1
    return out, deficit


#: Consecutive rows whose sums are taken together first, when sums of all earlier rows are wanted.
BLOCK = 1024


def sum_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, block: int | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the same ``keys`` with a lesser ``order`` (whole numbers, each once).

    Sums go by blocks of the order first: only one row a block passes through one task (for each
    key), and the rows of a block through another.
    """
    d = df.withColumn("__b", F.floor(F.col(order) / F.lit(block or BLOCK)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, "__b").agg(F.sum(value).alias("__v"))
    by_block = Window.partitionBy(*keys).orderBy("__b") if keys else Window.orderBy("__b")
    heads = sums.select(*keys, "__b", F.coalesce(F.sum("__v").over(earlier(by_block)), F.lit(0)).alias("__h"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy(*keys, "__b").orderBy(order))), F.lit(0))
    return d.withColumn("__i", inside).join(heads, [*keys, "__b"]).withColumn(name, F.col("__h") + F.col("__i")).drop("__b", "__h", "__i")


def pack(sizes: DataFrame, doc_id: str, source: str, tokens: str, limits: dict[str, int], mixture: dict[str, float] | None = None, tokens_per_shard: int = TOKENS_PER_SHARD, window: int = WINDOW) -> DataFrame:
    """Containers for every limit: one row per piece of a document.

    Result: ``limit_name``, ``capacity_tokens``, ``container_id``, ``window``, ``doc_id``,
    ``source``, ``piece``, ``start_token``, ``n_tokens``. Every document appears once for each
    limit; only one longer than the capacity is split, into full containers and a rest.

    Documents go to shards by a hash of their id, so a source with a third of all rows is spread
    over all shards and every shard is a sample of the whole. A shard draws windows from its
    sources by deficit round-robin to the target proportions (of ``mixture``, else of all
    tokens) and packs each window, largest first, into the open container it fills best; open
    containers and deficits are carried to the next window. The deficit with which a shard starts
    is what its predecessors leave: targets less actual tokens, summed over earlier shards from
    totals per shard and source.

    A null source is a source of its own; null ids and null sizes are left out; empty documents
    take no space; repeated ids are packed as often as they come; no documents or no limits, no containers.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    if any(v < 1 for v in limits.values()):
        raise ValueError("limits must be positive")
    schema = f"limit_name string, capacity_tokens int, container_id string, window int, `{doc_id}` {kinds[doc_id]}, `{source}` string, piece int, start_token long, n_tokens long"
    if not limits:
        return sizes.sparkSession.createDataFrame([], schema)
    rows = cut(sizes.where(F.col(doc_id).isNotNull() & F.col(tokens).isNotNull()).select(F.col(doc_id).alias("i"), F.coalesce(F.col(source), F.lit("")).alias("s"), F.col(tokens).cast("long").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / tokens_per_shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i"), F.lit(shards)))
    sums = rows.groupBy("shard", "s").agg(F.sum("n").alias("n"))
    by_source, by_shard = sums.groupBy("s").agg(F.sum("n").alias("n")), sums.groupBy("shard").agg(F.sum("n").alias("all"))
    if mixture is None:
        target = by_source.select("s", (F.col("n") / F.lit(max(total, 1))).alias("share"))
    else:
        whole = sum(mixture.values())
        given = F.create_map(*[F.lit(x) for s, v in mixture.items() for x in (s, float(v) / whole)])
        target = by_source.select("s", F.coalesce(F.element_at(given, F.col("s")), F.lit(0.0)).alias("share"))
    before = sum_before(by_shard, [], "shard", "all", "before").select("shard", "before")
    mine = sum_before(sums, ["s"], "shard", "n", "own").select("shard", "s", "own")
    carry = mine.join(target, "s").join(before, "shard").select("shard", "s", "share", (F.col("share") * F.col("before") - F.col("own")).alias("carry"))
    one = rows.select("shard", "i", "s", "n", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("carry"))
    two = carry.select("shard", F.lit(None).cast(kinds[doc_id]).alias("i"), "s", F.lit(None).cast("long").alias("n"), "share", "carry")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("limit_name"), F.lit(int(v)).alias("capacity")) for k, v in sorted(limits.items())]))
    both = one.unionByName(two).withColumn("l", each).select("shard", "i", "s", "n", "share", "carry", F.xxhash64("i").alias("h"), F.col("l.limit_name").alias("limit_name"), F.col("l.capacity").alias("capacity"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("i", "ascending")])
        name, shard, capacity = t["limit_name"][0].as_py(), t["shard"][0].as_py(), t["capacity"][0].as_py()
        extra = t.filter(pa.compute.is_valid(t["carry"]))
        share = dict(zip(extra["s"].to_pylist(), extra["share"].to_pylist()))
        start = dict(zip(extra["s"].to_pylist(), extra["carry"].to_pylist()))
        t = t.filter(pa.compute.is_valid(t["n"]))
        items = list(zip(t["n"].to_pylist(), t["s"].to_pylist(), range(t.num_rows)))
        got, _ = pack_shard(items, share, start, capacity, window)
        k = pa.array([g[0] for g in got], pa.int64())
        n = len(got)
        box = [f"{name}-{shard:06d}-{g[4]:07d}" for g in got]
        source_of = t["s"].take(k)
        return pa.table(
            {
                "limit_name": pa.array([name] * n, pa.string()), "capacity_tokens": pa.array([capacity] * n, pa.int32()), "container_id": pa.array(box, pa.string()), "window": pa.array([g[5] for g in got], pa.int32()),
                doc_id: t["i"].take(k), source: pa.compute.if_else(pa.compute.equal(source_of, ""), pa.scalar(None, pa.string()), source_of),
                "piece": pa.array([g[1] for g in got], pa.int32()), "start_token": pa.array([g[2] for g in got], pa.int64()), "n_tokens": pa.array([g[3] for g in got], pa.int64()),
            }
        )

    return both.groupBy("shard", "limit_name").applyInArrow(run, schema)


def read_limits(limits: DataFrame, name: str, capacity: str) -> dict[str, int]:
    """Limits by name; null names and capacities are left out, the least of a repeated name holds."""
    rows = limits.where(F.col(name).isNotNull() & (F.col(capacity) > 0)).groupBy(F.col(name).alias("k")).agg(F.min(capacity).alias("v")).limit(LIMITS + 1).collect()
    if len(rows) > LIMITS:
        raise ValueError(f"more than {LIMITS} limits")
    return {r.k: int(r.v) for r in rows}


def wholeness(packed: DataFrame, sizes: DataFrame, doc_id: str, tokens: str) -> DataFrame:
    """For each limit and document: whether its pieces are all of it, in order and once (``covered``), whether it is in one piece if it fits (``unsplit``), and whether none of its containers is overfull (``within``)."""
    over = packed.groupBy("limit_name", "container_id").agg((F.sum("n_tokens") <= F.max("capacity_tokens")).alias("within"))
    last = F.max_by(F.col("start_token") + F.col("n_tokens"), "piece")
    p = packed.join(over, ["limit_name", "container_id"]).groupBy("limit_name", doc_id).agg(
        F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("top"), F.countDistinct("piece").alias("different"), last.alias("last"), F.max("capacity_tokens").alias("capacity"), F.bool_and("within").alias("within"),
        F.bool_and((F.col("start_token") == F.col("piece") * F.col("capacity_tokens"))).alias("placed"),
    )
    s = sizes.groupBy(doc_id).agg(F.sum(tokens).alias("size"))
    covered = F.col("placed") & (F.col("n") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("pieces") == F.col("different")) & (F.col("top") == F.col("pieces") - 1)
    return p.join(s, doc_id).select("limit_name", doc_id, covered.alias("covered"), ((F.col("pieces") == 1) == (F.col("size") <= F.col("capacity"))).alias("unsplit"), "within")


def fill(packed: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, and the share of the containers' space that is used."""
    c = packed.groupBy("limit_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used")).where("used > 0")
    return c.groupBy("limit_name", "capacity_tokens").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / F.sum("capacity_tokens")).alias("fill"))


def deviations(packed: DataFrame, source: str, mixture: dict[str, float] | None = None) -> DataFrame:
    """Per limit and source: target and actual share of tokens, and the largest gap between them in any window but a shard's last, whose queues run dry.

    A window that makes up for a deficit carried from earlier shards strays from the target by as much.
    """
    shard = F.element_at(F.split("container_id", "-"), -2)
    w = packed.select("limit_name", shard.alias("shard"), "window", F.coalesce(source, F.lit("")).alias("s"), "n_tokens").groupBy("limit_name", "shard", "window", "s").agg(F.sum("n_tokens").alias("n"))
    whole = w.groupBy("limit_name", "shard", "window").agg(F.sum("n").alias("all"))
    inner = whole.join(whole.groupBy("limit_name", "shard").agg(F.max("window").alias("last")), ["limit_name", "shard"]).where(F.col("window") < F.col("last")).select("limit_name", "shard", "window", "all")
    every = w.groupBy("limit_name", "s").agg(F.sum("n").alias("n_tokens"))
    share = every.join(every.groupBy("limit_name").agg(F.sum("n_tokens").alias("total")), "limit_name").withColumn("actual", F.col("n_tokens") / F.col("total"))
    target = F.col("actual")
    if mixture is not None:
        given = F.create_map(*[F.lit(x) for s, v in mixture.items() for x in (s, float(v) / sum(mixture.values()))])
        target = F.coalesce(F.element_at(given, F.col("s")), F.lit(0.0))
    share = share.withColumn("target", target).select("limit_name", "s", "n_tokens", "target", "actual")
    gaps = w.join(inner, ["limit_name", "shard", "window"]).join(share.select("limit_name", "s", "target"), ["limit_name", "s"])
    worst = gaps.groupBy("limit_name", "s").agg(F.max(F.abs(F.col("n") / F.col("all") - F.col("target"))).alias("gap"), F.count("*").alias("met"))
    out = share.join(worst, ["limit_name", "s"], "left").join(inner.groupBy("limit_name").agg(F.count("*").alias("windows")), "limit_name", "left")
    zero = F.lit(0)
    missed = F.coalesce("windows", zero) > F.coalesce("met", zero)  # a source that a window lacks has the share 0 there
    gap = F.greatest(F.coalesce("gap", F.lit(0.0)), F.when(missed, F.col("target")).otherwise(0.0))
    return out.select("limit_name", F.nullif(F.col("s"), F.lit("")).alias(source), "n_tokens", "target", "actual", gap.alias("largest_gap"))
