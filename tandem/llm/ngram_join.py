"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

Texts with A-Z in lower case are sets of word shingles.  Two link when ``100 * |x & y| >= percent * |x | y|``.

* **Order.**  Shingles are ordered by estimated document frequency, rare first, then by hash.  Any order gives right
  results; frequencies of the frequent shingles only keep lists short.  They are counted over all documents; the table of
  them goes to every task, and a threshold read from its own histogram holds it to ``HEAVY`` entries.
* **Prefixes.**  Of n shingles a partner must share ``a = ceil(percent * n / 100)``.  So the first ``n - a + l`` of both
  sides share at least ``l`` (with each side's own ``l``, the smaller).  ``l = 1`` is the plain prefix filter.  Each document
  takes the ``l`` of least estimated cost: places on the lists of its prefix, plus candidates, at most places / ``l``.
* **Matches.**  Beyond the prefixes a pair can share no more than the longer of the two rests, so a link takes
  ``c >= max(min(l), ceil(percent * (n + n') / (100 + percent)) - max(a - l, a' - l'))`` shared prefix shingles.
* **Links.**  Equal sets are one node from the start: a task posts a set once however many copies it reads.  Each list
  first pairs its nodes with ``REPS`` of them only; pairs with enough matches are verified and give components.  Lists that still
  hold several components pair their nodes with two more: the node that is on most such lists (mostly the text that the others are
  edits of), and that of another component; and again, while this joins components.  Then pairs of one list whose nodes are
  still in *different* components are counted over their lists inside tasks and held against the matches that a link takes.
  Only nodes that have such a pair leave these tasks, with their lists; they are cut in blocks of about ``MEET``, each two
  blocks of a group meet in a task with their sets, and there the pairs are verified.  Only links leave it, so no pair becomes a
  row.  A pair within a component needs no check: a link inside it changes nothing.  So no link is lost, while a group of
  n near copies costs n pairs and not n * n.
* **Verification.**  A representative's text goes to a task once, followed by those it is held against (:mod:`tandem.llm.verify`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import WORD, alone, arrow_map, likely, one_per_id, record, written
from tandem.llm.components import connected_components
from tandem.llm.verify import verified

#: Most entries of the table of frequent shingles.
HEAVY = 1 << 18
#: Least count of a shingle among one task's documents for the estimate.
LOCAL = 2
#: Texts (bytes) over which a task adds up its counts before it gives them out.
FLUSH = 16 << 20
#: Texts (bytes) that a task looks at together.
TAKE = 1 << 20
MATCHES = (1, 2, 4, 8)
#: What checking a candidate costs, in places read from a list.
VERIFY = 16
#: Nodes of a list that all its others are held against first.
REPS = 8
#: Rounds of further representatives at most; what they leave is counted pair by pair.
ROUNDS = 3
#: Nodes of a block, when those that are still in different components are held against one another.
MEET = 512
#: Sets that a task remembers having posted.
SEEN = 1 << 18


def _keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, independent of its order; 0 marks the empty set."""
    total = np.concatenate([np.zeros(1, K.U64), np.cumsum(K.mix(h ^ K._C3))])
    n = np.diff(first).astype(K.U64)
    key = K.mix(total[first[1:]] - total[first[:-1]] + n * K._C1)
    key[key == 0] = K.U64(1)
    key[n == 0] = K.U64(0)
    return key


def _sets(k: int):
    """Rows (0, doc_id, key, n) of each document and (1, shingle, count, 0) of shingles that a task's documents share."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        held: list[np.ndarray] = []
        size = 0
        to = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

        def counts():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            h, c = h[c >= LOCAL], c[c >= LOCAL]
            return record({"kind": np.ones(len(h), np.int8), "a": K.signed(h), "b": c, "n": np.zeros(len(h), np.int64)}, to)

        for batch in batches:
            for rows, texts in K.blocks(batch, limit=TAKE):
                h, first = K.shingles(K.lower(texts), k)
                yield record({"kind": np.zeros(len(texts), np.int8), "a": rows.column("doc_id"), "b": K.signed(_keys(h, first)), "n": np.diff(first)}, to)
                held.append(h)
                size += len(texts.data)
                if size > FLUSH:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()

    return sets


def _heavy(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts; as many as fit in ``HEAVY``."""
    total = written(counts.groupBy("a").agg(F.sum("b").alias("c")))
    bins = sorted(((r.e, r.n) for r in total.groupBy(F.floor(F.log2("c")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = None, HEAVY
    for e, n in bins:
        if n > room:
            break
        least, room = e, room - n
    if least is None:
        return np.zeros(0, K.U64), np.zeros(0, np.int64)
    got = total.where(F.floor(F.log2("c")) >= least).toArrow()
    h, c = K.unsigned(got.column("a").to_numpy()), got.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def _postings(k: int, percent: int, table):
    """(shingle, key, n and l) of the prefix of each distinct set among a task's documents."""
    to = pa.schema([(c, pa.int64()) for c in ("h", "key", "meta")])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        heavy, count = table.value
        seen: set[int] = set()
        for batch in batches:
            for _, texts in K.blocks(batch, limit=TAKE):
                h, first = K.shingles(K.lower(texts), k)
                key, n = _keys(h, first), np.diff(first)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = [i for i, x in enumerate(key.tolist()) if x and x not in seen and not seen.add(x)]
                if not fresh:
                    continue
                fresh = np.array(fresh)
                at, cut = K.ragged(first, fresh)
                h, first, key, n = h[at], cut, key[fresh], n[fresh]
                row = K.row_of(first)
                df = np.ones(len(h), dtype=np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    known = heavy[at] == h
                    df[known] = count[at[known]]
                    if known.any():
                        order = np.lexsort((df, row))  # stable: by hash where frequencies are equal
                        h, df = h[order], df[order]
                places = np.concatenate([[0], np.cumsum(df - 1)])
                share = -(-percent * n // 100)
                best, l = np.full(len(n), np.inf), np.ones(len(n), np.int64)
                for m in MATCHES:
                    fits = share >= m
                    met = places[first[:-1] + np.where(fits, n - share + m, 0)] - places[first[:-1]]
                    cost = np.where(fits, met + (VERIFY / m) * met + m, np.inf)
                    l[cost < best] = m
                    best = np.minimum(best, cost)
                take = np.arange(len(h)) - first[:-1][row] < (n - share + l)[row]
                yield record({"h": K.signed(h[take]), "key": K.signed(key[row[take]]), "meta": (n * 16 + l)[row[take]]}, to)

    return postings


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of whole runs of equal first column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        h = batch.column(0).to_numpy()
        cut = len(h) - int(np.argmax((h != h[-1])[::-1])) if h[0] != h[-1] else 0
        if cut or held and held[0].column(0)[0].as_py() != h[0]:
            done = [*held, batch.slice(0, cut)]
            t = pa.Table.from_batches([x for x in done if len(x)]) if any(len(x) for x in done) else None
            held = []
            if t is not None:
                yield tuple(c.to_numpy() for c in t.columns)
        held.append(batch.slice(cut))
    if held:
        yield tuple(c.to_numpy() for c in pa.Table.from_batches(held).columns)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return at, np.diff(np.append(at, len(h)))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, key, meta) to (h, key, meta, rep, rep_meta) for lists of two nodes or more: each node with itself, and with
    those of the list's ``REPS`` representatives that are others.  Representative i is the node of least hash by seed i, so
    lists of a group of near copies mostly choose the same."""
    to = pa.schema([(c, pa.int64()) for c in ("h", "key", "meta", "rep", "rep_meta")])
    for h, key, meta in _lists(batches):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])  # copies of one set stand together
        h, key, meta = h[new], key[new], meta[new]
        _, size = _runs(h)
        several = np.repeat(size > 1, size)
        h, key, meta = h[several], key[several], meta[several]
        if not len(h):
            continue
        yield record({"h": h, "key": key, "meta": meta, "rep": key, "rep_meta": meta}, to)
        at, size = _runs(h)
        chosen: list[np.ndarray] = []
        for i in range(REPS):
            order = K.mix(K.unsigned(key) + K.U64(i + 1) * K._C1)
            first = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, at), size))
            rep = np.repeat(first, size)
            fresh = key != key[rep]
            for other in chosen:
                fresh &= rep != other
            chosen.append(rep)
            if fresh.any():
                yield record({"h": h[fresh], "key": key[fresh], "meta": meta[fresh], "rep": key[rep[fresh]], "rep_meta": meta[rep[fresh]]}, to)


def _enough(percent: int, ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
    """How many shared prefix shingles a link between two documents takes, from their sizes and ``l``."""
    na, nb, la, lb = ma // 16, mb // 16, ma % 16, mb % 16
    rest = np.maximum((percent * na + 99) // 100 - la, (percent * nb + 99) // 100 - lb)
    return np.maximum(np.minimum(la, lb), -(-percent * (na + nb) // (100 + percent)) - rest)


def _across(percent: int):
    """(lo, h, key, meta, comp, rest) sorted by lo to the nodes, with their lists, that share enough of them with one of another component.

    Lists with the same least component ``lo`` come together, as those of one group do.  For one node after another the nodes
    of its lists are counted, so a task holds a group's lists and one row of counts, never its pairs.  ``rest`` is how many lists
    a node has elsewhere: a pair that can't reach what a link takes even with those doesn't count.
    """

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = pa.schema([*((c, pa.int64()) for c in ("lo", "key", "meta", "comp", "rest")), ("lists", pa.binary())])
        for lo, h, key, meta, comp, rest in _lists(batches):
            for x, y in zip(*(v.tolist() for v in _bounds(lo)), strict=True):
                nodes, first, node = np.unique(key[x:y], return_index=True, return_inverse=True)
                m, of, elsewhere = meta[x:y][first], comp[x:y][first], rest[x:y][first]
                lists = _Lists(h[x:y], node, len(nodes))
                near = np.zeros(len(nodes), dtype=bool)
                for a in range(len(nodes)):
                    b = lists.enough(percent, a, m, elsewhere, of != of[a])
                    near[b[b > a]] = True
                    near[a] |= bool(len(b))
                at = np.flatnonzero(near)
                if len(at):
                    yield record({"lo": np.full(len(at), lo[x]), "key": nodes[at], "meta": m[at], "comp": of[at], "rest": elsewhere[at], "lists": [lists.of(a).tobytes() for a in at]}, to)

    return across


class _Lists:
    """Which nodes are on which lists: a list ``h`` and the number of a node for each place."""

    def __init__(self, h: np.ndarray, node: np.ndarray, n: int):
        self.n = n
        by_node = np.argsort(node, kind="stable")
        self.name, code = np.unique(h, return_inverse=True)
        self.lists, self.first = code[by_node], np.searchsorted(node[by_node], np.arange(n + 1))
        by_list = np.argsort(code, kind="stable")
        self.member, self.list_first = node[by_list], np.searchsorted(code[by_list], np.arange(len(self.name) + 1))

    def of(self, a: int) -> np.ndarray:
        return self.name[self.lists[self.first[a] : self.first[a + 1]]]

    def enough(self, percent: int, a: int, meta: np.ndarray, elsewhere: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nodes ``among`` which a link with ``a`` isn't ruled out by sizes or by the lists that both share."""
        places, _ = K.ragged(self.list_first, self.lists[self.first[a] : self.first[a + 1]])
        c = np.bincount(self.member[places], minlength=self.n)
        b = np.flatnonzero((c > 0) & among)
        x, y = meta[b] // 16, meta[a] // 16
        b = b[100 * np.minimum(x, y) >= percent * np.maximum(x, y)]
        return b[c[b] + np.minimum(elsewhere[b], elsewhere[a]) >= _enough(percent, np.full(len(b), meta[a]), meta[b])]


def _own_set(k: int):
    """(key, text) to (key, own): the set as bytes of its hashes."""

    def own_set(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch, limit=TAKE):
            h, first = K.shingles(K.lower(texts), k)
            yield {"key": rows.column("key"), "own": [h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]}

    return own_set


def _meet(percent: int):
    """Sorted (g, side, key, meta, comp, rest, lists, own) to the links (u, v) that join components of a group g, between its two sides or
    inside its one."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        to = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for g, side, *columns in _lists(batches):
            for x, y in zip(*(v.tolist() for v in _bounds(g)), strict=True):
                key, meta, comp, rest, lists, own = (c[x:y] for c in columns)
                n, two = y - x, bool(side[x:y].any())
                lists = _Lists(np.frombuffer(b"".join(lists), np.int64), np.repeat(np.arange(n), [len(v) // 8 for v in lists]), n)
                first = np.concatenate([[0], np.cumsum([len(v) // 8 for v in own])])
                names, shingle = np.unique(np.frombuffer(b"".join(own), K.U64), return_inverse=True)
                size, of, mark = np.diff(first), comp.copy(), np.zeros(len(names), dtype=bool)
                other = side[x:y] == 1 if two else np.ones(n, dtype=bool)
                u, v = [], []
                for a in np.flatnonzero(side[x:y] == 0).tolist():
                    b = lists.enough(percent, a, meta, rest, other & (of != of[a]))
                    b = b if two else b[b > a]
                    if not len(b):
                        continue
                    mine = shingle[first[a] : first[a + 1]]
                    mark[mine] = True
                    at, cut = K.ragged(first, b)
                    same = np.add.reduceat(mark[shingle[at]].astype(np.int64), cut[:-1])
                    mark[mine] = False
                    for j in b[100 * same >= percent * (size[a] + size[b] - same)].tolist():
                        if of[j] != of[a]:
                            of[of == of[j]] = of[a]
                            u.append(int(key[a]))
                            v.append(int(key[j]))
                if u:
                    yield record({"u": np.array(u), "v": np.array(v)}, to)

    return meet


def _bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, size = _runs(x)
    return at, at + size


def ngram_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): size of each set and the least id that links reach.

    Nulls and empties: a null text, an empty one or one without words has the empty set, links with nothing and is its own
    component.  Rows without an id take no part; repeated ids as in :func:`tandem.llm.common.one_per_id`.  Sizes and
    intersections are exact over 64-bit shingle hashes; equal 64-bit digests of sets stand for equal sets.  An empty
    table gives an empty table.  Other columns are not looked at.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be 1 to 100")
    spark = docs.sparkSession
    own = one_per_id(docs, id_col, text_col)
    from tandem.shipping import ship

    ship(spark)
    first = written(own.select("doc_id", "text").mapInArrow(_sets(k), "kind byte, a long, b long, n long"))
    sets = first.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n")
    table = spark.sparkContext.broadcast(_heavy(first.where("kind = 1")))
    nodes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    posted = own.select("text").mapInArrow(_postings(k, percent, table), "h long, key long, meta long")
    sorted_ = posted.repartition("h").sortWithinPartitions("h", "key")
    lists = written(sorted_.mapInArrow(_stars, "h long, key long, meta long, rep long, rep_meta long"))

    n, l = (lambda c: F.floor(F.col(c) / 16)), (lambda c: F.col(c) % 16)
    rest = lambda c: F.floor((percent * n(c) + 99) / 100) - l(c)
    union = F.ceil(percent * (n("meta") + n("rep_meta")) / F.lit(100 + percent))
    enough = F.greatest(F.least(l("meta"), l("rep_meta")), union - F.greatest(rest("meta"), rest("rep_meta")))
    fits = 100 * F.least(n("meta"), n("rep_meta")) >= percent * F.greatest(n("meta"), n("rep_meta"))

    def matched(pairs: DataFrame) -> DataFrame:
        """Pairs (key, rep), with the lists they share, that share as many as a link takes."""
        return pairs.groupBy("key", "rep", "meta", "rep_meta").agg(F.sum("c").alias("c")).where(F.col("c") >= enough).select("key", "rep")

    swap = F.col("key") > F.col("rep")
    ends = lambda a, b: [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a), F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b)]

    def met(pairs: DataFrame) -> DataFrame:
        """Pairs of a list's node and a representative of it that share as many lists as a link takes."""
        some = pairs.where("key <> rep").where(fits)
        return matched(some.select("h", *ends("key", "rep"), *ends("meta", "rep_meta"), F.lit(1).cast("long").alias("c")))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (key, rep) that link; only texts of documents in them are dealt out."""
        ends = pairs.select("key").unionByName(pairs.select(F.col("rep").alias("key"))).distinct()
        wanted = written(nodes.join(ends, "key"))
        texts = written(likely(own, wanted).join(wanted, "doc_id").select("key", "text"))
        return verified(pairs.select(F.col("key").alias("u"), F.col("rep").alias("v")), texts, lambda t: K.shingles(K.lower(t), k), percent)

    def labels(near: DataFrame) -> DataFrame:
        return written(connected_components(near).withColumnRenamed("node", "key"))

    def mixed(placed: DataFrame, label: DataFrame) -> DataFrame:
        """(lo, h, key, meta, comp) of the lists that hold several components."""
        placed = written(placed.join(label, "key", "left").select("h", "key", "meta", F.coalesce("component", "key").alias("comp")))
        several = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h", "lo")
        return written(placed.join(several, "h").select("lo", "h", "key", "meta", "comp"))

    tried = written(met(lists))
    near = links(tried)
    label = labels(near)
    open_lists = mixed(lists.where("key = rep").select("h", "key", "meta"), label)
    for _ in range(ROUNDS):
        scored = open_lists.join(open_lists.groupBy("key").agg(F.count(F.lit(1)).alias("score")), "key")
        best = scored.groupBy("h").agg(F.max(F.struct("score", "key", "meta", "comp")).alias("r"))
        other = scored.join(best, "h").where(F.col("comp") != F.col("r.comp")).groupBy("h").agg(F.max(F.struct("score", "key", "meta", "comp")).alias("q"))
        held = open_lists.join(best.join(other, "h"), "h").withColumn("r", F.explode(F.array("r", "q"))).where(F.col("comp") != F.col("r.comp"))
        pairs = met(held.select("h", "key", "meta", F.col("r.key").alias("rep"), F.col("r.meta").alias("rep_meta")).distinct())
        pairs = written(pairs.join(tried, ["key", "rep"], "left_anti"))
        more = links(pairs)
        if not more.limit(1).count():
            break
        near, tried = near.unionByName(more), tried.unionByName(pairs)
        label = labels(near)
        open_lists = mixed(open_lists.select("h", "key", "meta"), label)
    here = open_lists.groupBy("lo", "key").agg(F.count(F.lit(1)).alias("here"))
    total = here.groupBy("key").agg(F.sum("here").alias("total"))
    rest = here.join(total, "key").select("lo", "key", (F.col("total") - F.col("here")).alias("rest"))
    dealt = open_lists.join(rest, ["lo", "key"]).repartition("lo").select("lo", "h", "key", "meta", "comp", "rest").sortWithinPartitions("lo")
    apart = written(dealt.mapInArrow(_across(percent), "lo long, key long, meta long, comp long, rest long, lists binary"))
    wanted = written(nodes.join(apart.select("key").distinct(), "key"))
    texts = likely(own, wanted).join(wanted, "doc_id").select("key", "text")
    whole = arrow_map(texts, _own_set(k), "key long, own binary")
    blocks = F.ceil(F.col("n") / MEET).cast("int")
    placed = apart.join(apart.groupBy("lo").agg(F.count(F.lit(1)).alias("n")), "lo").withColumn("i", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    met_in = placed.withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1))).join(whole, "key")
    group = F.xxhash64("lo", F.least("i", "j"), F.greatest("i", "j")).alias("g")
    rows = met_in.select(group, F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("side"), "key", "meta", "comp", "rest", "lists", "own")
    far = written(rows.repartition("g").sortWithinPartitions("g").mapInArrow(_meet(percent), "u long, v long"))
    if far.limit(1).count():
        label = labels(near.unionByName(far))
    members = sets.where("n > 0").join(label, "key", "left").select("doc_id", "n", F.coalesce("component", "key").alias("comp"))
    least = members.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (
        members.join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    )


def one_per_component(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (rows without an id last, then by a hash of the text).

    Rows count one by one, named by a 64-bit hash of id and text: of repeated rows one stays, rows of one id with different texts are
    different documents, and rows without an id are held by their texts.  A text without words links with nothing: of such rows
    those of one id and text are one, and all without an id stay.
    """
    id_, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    named = docs.withColumn("__key", F.xxhash64(id_, text))
    own = named.select("__key", id_.alias("id"), text.alias("text"))
    ids = own.groupBy("__key").agg(F.min("id").alias("id"))
    classes = ngram_components(own, k, percent, id_col="__key").join(ids, F.col("doc_id") == F.col("__key"))
    least = classes.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("least"))
    kept = named.join(least.select(F.col("least.doc_id").alias("__stay")), F.col("__key") == F.col("__stay"), "left_semi")
    lone = id_.isNull() & ~F.coalesce(F.rlike(text, F.lit(WORD)), F.lit(False))
    if named.where(~lone).groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        turn = Window.partitionBy("__key").orderBy(F.to_json(F.struct(*[docs[f"`{c}`"] for c in docs.columns])))
        once = kept.where(~lone).withColumn("__turn", F.row_number().over(turn)).where(F.col("__turn") <= 1).drop("__turn")
        kept = once.unionByName(kept.where(lone))
    return kept.drop("__key")
