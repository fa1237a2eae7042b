"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources they belong to). Words
flow from patterns to the quotas of sources; a pattern's first copy is cheap, each
further copy dearer (convex cost), so repetition is spread as evenly as the quotas
allow. The flow sees one node per pattern and per source, never documents. Documents
of a pattern are then taken in the order of a seeded hash until its flow is used up.

The boundary of each pattern is found by narrowing hash prefixes: each round sums the
sizes of a few thousand prefixes, so no group is ordered in one task, and repeated rows
differ by a row number written with the staged sizes.

A null text has size 0 and is taken 0 times; a null source is a source of its own,
ordered last. Repeated rows count once each; which of two equal rows is taken does not
show. An empty table gives an empty mix. Only the named columns are read. More than
``MAX_PATTERNS`` patterns raise an error.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kit

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = "0"
MAX_PATTERNS = 100_000
# Bytes of names that are sent to every task.
MAX_BROADCAST = 16 << 20
# Hexadecimal digits of the order key that one round looks at.
DIGITS = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(kit.SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict:
    """Target words of each source: ``share`` of all words by weight, at most ``most`` times its size.

    What a capped source cannot take is shared by weight among the others. Sources are
    weighted in code point order, null last, the weights repeating.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: float(most * sizes[s]) for s in order}
    left, heavy = share * sum(sizes.values()), sum(weight.values())
    level = 0.0
    for s in sorted(order, key=lambda s: cap[s] / weight[s]):
        level = left / heavy
        if level * weight[s] <= cap[s]:
            break
        left, heavy = left - cap[s], heavy - weight[s]
    return {s: min(cap[s], level * weight[s]) for s in order}


def route(tokens: list[int], members: list[list[int]], quotas: list[int], most: int = MOST_COPIES) -> list[dict[int, int]]:
    """Words that go from each pattern to each of its sources, at least cost.

    Copy k of a pattern costs k for each word. Successive phases raise the price and
    push all flow that this price allows.
    """
    n = len(tokens) + len(quotas) + 2
    start, end = n - 2, n - 1
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, size: int, price: int) -> int:
        for x, y, r, c in ((a, b, size, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
        return len(to) - 2

    links = []
    for p, size in enumerate(tokens):
        for copy in range(most):
            edge(start, p, size, copy + 1)
        links.append({s: edge(p, len(tokens) + s, most * size, 0) for s in members[p]})
    for s, quota in enumerate(quotas):
        edge(len(tokens) + s, end, quota, 0)
    while True:
        far = [float("inf")] * n
        far[start] = 0
        queue, waiting = deque([start]), [False] * n
        while queue:
            x = queue.popleft()
            waiting[x] = False
            for e in graph[x]:
                if room[e] and far[x] + cost[e] < far[to[e]]:
                    far[to[e]] = far[x] + cost[e]
                    if not waiting[to[e]]:
                        waiting[to[e]] = True
                        queue.append(to[e])
        if far[end] == float("inf"):
            return [{s: room[e ^ 1] for s, e in out.items() if room[e ^ 1]} for out in links]
        # Push along cheapest edges until none leads to the end; dead ends are met once.
        while True:
            path, seen, used = [], {start}, [0] * n
            x = start
            while x != end:
                for i in range(used[x], len(graph[x])):
                    e = graph[x][i]
                    if room[e] and far[x] + cost[e] == far[to[e]] and to[e] not in seen:
                        used[x] = i + 1
                        path.append(e)
                        x = to[e]
                        seen.add(x)
                        break
                else:
                    used[x] = len(graph[x])
                    if not path:
                        break
                    x = to[path.pop() ^ 1]
            if x != end:
                break
            push = min(room[e] for e in path)
            for e in path:
                room[e] -= push
                room[e ^ 1] += push


def _boundaries(sized: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[str, int]]:
    """For each pattern number: the key at which its remainder is used up, and what that document gives."""
    spark = sized.sparkSession
    state = {p: ("", r) for p, r in wanted.items() if r}
    done: dict[int, tuple[str, int]] = {}
    depth = 0
    while state:
        rows = [(p, prefix, r) for p, (prefix, r) in state.items()]
        open_ = spark.createDataFrame(rows, "pattern int, prefix string, rest long")
        depth += DIGITS
        digits = F.substring("key", 1, depth)
        # At most MAX_PATTERNS short rows, here and below: the documents stay where they are.
        sums = sized.join(F.broadcast(open_), ["pattern"]).where(F.col("key").startswith(F.col("prefix"))).groupBy(
            "pattern", digits.alias("digits")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("rest").alias("rest"))
        before = F.sum("size").over(Window.partitionBy("pattern").orderBy("digits")) - F.col("size")
        hit = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        state = {}
        for r in hit.select("pattern", "digits", "n", (F.col("rest") - F.col("before")).alias("rest")).collect():
            (done if r["n"] == 1 else state)[r["pattern"]] = (r["digits"], r["rest"])
    return done


def mix(
    docs: DataFrame, members: Column, size: Column, quota_of=targets, seed: str = SEED, most: int = MOST_COPIES,
    id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None,
) -> tuple[DataFrame, dict, dict]:
    """(rows of every document with its taken words, sizes of sources, targets of sources).

    ``members`` is the array of sources of a document, ``size`` its words; ``quota_of``
    maps the sizes of sources to their targets. Rows carry doc_id, sources, size, taken
    (words, repeats counted) and the columns ``keep`` of ``docs`` (all if None) under ``row``.
    """
    spark = docs.sparkSession
    order = F.md5(F.concat_ws("|", F.lit(seed), docs[id_column].cast("string"), F.md5(kit.null_text(docs[text_column]).cast("binary"))).cast("binary"))
    tag = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    sized = kit.stage(docs.select(
        docs[id_column].alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("sources"), size.alias("size"),
        F.concat(order, tag).alias("key"), F.struct(*[docs[c] for c in (docs.columns if keep is None else keep)]).alias("row"),
    ), "mix")
    groups = sized.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    groups.sort(key=lambda g: [(s is None, s or "") for s in g["sources"]])
    sizes: dict = {}
    for g in groups:
        for s in g["sources"]:
            sizes[s] = sizes.get(s, 0) + g["size"]
    wanted = quota_of(sizes)
    names = list(wanted)
    place = {s: i for i, s in enumerate(names)}
    quotas = [int(wanted[s] + 0.5) for s in names]
    flow = route([g["size"] for g in groups], [[place[s] for s in g["sources"]] for g in groups], quotas, most)
    total = [sum(f.values()) for f in flow]
    copies = [t // g["size"] if g["size"] else 0 for t, g in zip(total, groups)]
    pattern = spark.createDataFrame(
        [(g["sources"], i, c) for i, (g, c) in enumerate(zip(groups, copies))],
        "sources array<string>, pattern int, copies long",
    )
    keyed = _same_sources(sized, pattern)
    edges = _boundaries(keyed.select("pattern", "key", "size"), {i: t - c * g["size"] for i, (t, c, g) in enumerate(zip(total, copies, groups))})
    ends = spark.createDataFrame([(p, key, rest) for p, (key, rest) in edges.items()], "pattern int, edge string, rest long")
    cut = F.substring("key", 1, F.length("edge"))
    extra = F.when(cut < F.col("edge"), F.col("size")).when(cut == F.col("edge"), F.col("rest")).otherwise(0)
    taken = F.col("copies") * F.col("size") + F.coalesce(extra, F.lit(0))
    return keyed.join(F.broadcast(ends), "pattern", "left").select("doc_id", "sources", "size", taken.cast("long").alias("taken"), "row"), sizes, wanted


def _same_sources(sized: DataFrame, pattern: DataFrame) -> DataFrame:
    """Number the patterns; the text of an array is its key, since arrays may hold null."""
    text = F.to_json(F.struct("sources"), {"ignoreNullFields": "false"})
    named = pattern.select(text.alias("k"), "pattern", "copies")
    return sized.withColumn("k", text).join(named, "k").drop("k")


def mix_report(docs: DataFrame) -> DataFrame:
    """Mix documents of one source each: doc_id, source, size, source_size, target, taken."""
    rows, sizes, wanted = mix(docs, F.array(docs["source"].cast("string")), words_in(docs["text"]), keep=["doc_id"])
    table = docs.sparkSession.createDataFrame(
        [(s, sizes[s], wanted[s]) for s in wanted], "name string, source_size long, target double",
    )
    # One row a pattern; names of sources beyond the bound are left to Spark's choice of join.
    if sum(len(s or "") + 64 for s in wanted) <= MAX_BROADCAST:
        table = F.broadcast(table)
    source = F.col("sources")[0]
    return rows.select("doc_id", source.alias("source"), "size", "taken").join(
        table, F.col("source").eqNullSafe(table["name"])).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at the boundary if at least half."""
    rows, _, _ = mix(docs, F.array(docs["source"].cast("string")), words_in(docs["text"]))
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    picked = rows.where(F.col("size") > 0).withColumn("times", times).where(F.col("times") > 0)
    return picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
