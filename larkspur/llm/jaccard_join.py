"""N-gram Jaccard join by parity sketches; exact.

A document's shingle set is XOR-hashed into a parity sketch: a shingle picks a
segment and a bit in it and flips that bit.  A shingle in only one of two sets
changes at most one bit, so the sketches' Hamming distance is at most the
symmetric difference.  At Jaccard similarity s that difference is at most
(1 - s) / (1 + s) * (|A| + |B|) =: d, hence at most d of a document's segments
differ, and two linked documents agree in one of the first d + 1 of their
segments, in whatever order, so long as the order is common to all.  That is the
pigeonhole join.  It is done per size band: sizes from m to 2 m - 1 have m
segments, so that a segment holds one to two shingles, and a document that may
pair with a smaller one in the band below joins there as well.  Small sets, where
a few shingles must not meet, are one band of very many segments.  Segments are
very wide (2^58 bits) and sparse, so a key of a segment is the XOR of the hashes
of its bits; an empty segment is a key too, and comes last.  The order puts
segments later whose shingles are all known to be frequent; it changes cost,
never the result.

Documents with equal sets are one class, and only classes are joined.  Classes
that share a segment's key are a group, and groups of the same least class are one
family.  Three steps follow:

1. Within a family, dense sketches (2 bits or more for each shingle) tell which
   classes look alike.  Each block of a family gives a spanning forest of its
   alike pairs, never the pairs.
2. The components of all forests are clusters; no link leaves its cluster.  A
   class is in one cluster, so its text travels once.
3. Within a cluster, pairs that look alike and are not connected yet are verified
   on the texts' shingles; again each block gives a forest, and the components of
   these links are the result.

A family or cluster of more than `block` members, or of too many shingles for one
task, is dealt over about as many blocks as each has members, times a constant.
First every member is compared within its block and with some 32 members that
all blocks get.  What is then outside the largest component of its family visits
all blocks, so no pair of different components is left uncompared.  Work is thus
in proportion to the members, and only those outside the largest component meet all others.

Scale: shingles never leave the task that reads the text.  Shuffled are the
segment keys (16 bytes each, about 0.4 for each shingle), the families' sketches
(2 to 4 bits a shingle) and the texts of clusters, twice.  The map that
screens texts before they travel has a fixed size; where it is full, all texts
travel to be joined with the list of clusters.

Defined cases: null and empty texts have the empty set and link with nothing; a
text of fewer than `k` words has one shingle, the whole sequence; rows with
equal doc_id are one document if their texts are equal, and otherwise share
their component; null ids keep a component of null; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget_partitioning, hashed_words, mix64, quoted, text_chunks, worker_cache
from .components import components

#: Sets of fewer shingles are the lowest band; from there on sizes from m to 2 m - 1 are one.
LOWEST = 64
#: Bytes of text worked on at once; bounds a task's memory beside the longest single text.
CHUNK_BYTES = 1 << 21


class Sets:
    """Shingle sets of a run of texts: token[i] belongs to text doc[i]; by text sorted and distinct."""

    def __init__(self, texts: list[bytes], k: int):
        word, of = hashed_words(texts)
        self.n_texts = len(texts)
        if not len(word):
            self.token, self.doc = np.empty(0, np.uint64), np.empty(0, np.int64)
        else:
            odd = mix64(np.arange(77, 77 + k, dtype=np.uint64)) | np.uint64(1)
            n = len(word)
            token, doc = np.empty(0, np.uint64), np.empty(0, np.int64)
            if n >= k:
                total = np.zeros(n - k + 1, np.uint64)
                for i in range(k):
                    total += word[i : n - k + 1 + i] * odd[i]
                whole = of[: n - k + 1] == of[k - 1 :]
                token, doc = mix64(total[whole]), of[: n - k + 1][whole]
            # Texts of fewer than k words: one shingle, told apart by its length.
            count = np.bincount(of, minlength=self.n_texts)
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            short = np.flatnonzero((count > 0) & (count < k))
            if len(short):
                few = [int((word[start[d] : start[d] + count[d]] * odd[: count[d]]).sum(dtype=np.uint64)) for d in short.tolist()]
                few = mix64(mix64(np.array(few, np.uint64)) + count[short].astype(np.uint64))
                token, doc = np.concatenate([token, few]), np.concatenate([doc, short])
            order = np.argsort(token)
            # A stable sort of 16-bit numbers is a radix sort.
            order = order[np.argsort(doc[order].astype(np.uint16) if self.n_texts < 65536 else doc[order], kind="stable")]
            token, doc = token[order], doc[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
            self.token, self.doc = token[new], doc[new]
        self.size = np.bincount(self.doc, minlength=self.n_texts)
        self.start = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit prints of each set, 0 for the empty one."""
        out = []
        some = self.size > 0
        for salt in (0, 0x77):
            p = np.zeros(self.n_texts, np.uint64)
            if some.any():
                p[some] = np.add.reduceat(mix64(self.token ^ np.uint64(salt)), self.start[:-1][some])
            out.append(p.view(np.int64))
        return out[0], out[1]

    def only(self, chosen: np.ndarray) -> "Sets":
        """The sets of the chosen texts (a mask); others become empty."""
        out = object.__new__(Sets)
        mine = chosen[self.doc]
        out.token, out.doc, out.n_texts = self.token[mine], self.doc[mine], self.n_texts
        out.size = np.where(chosen, self.size, 0)
        out.start = np.concatenate([[0], np.cumsum(out.size)]).astype(np.int64)
        return out

    def set_of(self, i: int) -> np.ndarray:
        return self.token[self.start[i] : self.start[i + 1]]


def _chunks(texts: list[str | None]):
    return text_chunks(texts, CHUNK_BYTES)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words."""
    return Sets([t for _, some in _chunks([text]) for t in some], k).token


def _band(n: int) -> int:
    """Index of the band of size n."""
    return (n // LOWEST).bit_length()


def _segments(band: int) -> int:
    """Segments of a band's sketch.  The pigeonhole needs more than d of them, and d is under 4/7 of a band's least size."""
    return LOWEST << (band - 1) if band else 1 << 39


def most_different(a: int, b: int, need: int, of: int = 100) -> int:
    """The largest symmetric difference of linked sets of sizes a and b: of * i >= need * u."""
    least = -(-need * (a + b) // (of + need))  # the least intersection
    return a + b - 2 * least


def segment_keys(sets: Sets, bands: np.ndarray, counts: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text): for each text the keys of the first `counts` segments, in the
    common order, of its sketch of its band; segments that tie with the last of these as well."""
    if not len(sets.token):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = sets.doc
    of_band = np.array([_segments(b) for b in range(int(bands.max()) + 1)], np.uint64)
    spread = mix64(sets.token)
    segment = spread % of_band[bands[doc]]
    # Texts are few and segments below 2^40, so both fit one number.
    both = (doc.astype(np.uint64) << np.uint64(40)) | segment
    order = np.argsort(both)
    both, spread = both[order], spread[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    bits = np.bitwise_xor.reduceat(mix64(spread ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    distinct, owner = both[first], doc[order][first]
    key = mix64(bits ^ mix64((distinct & np.uint64((1 << 40) - 1)) * np.uint64(64) + bands[owner].astype(np.uint64)))
    hot = np.zeros(len(key), np.uint64)
    if len(frequent):
        known = worker_cache("jaccard_filter", dict)
        if known.get("of") is not frequent:
            table = np.zeros(1 << 22, bool)
            table[(frequent >> np.uint64(42)).astype(np.int64)] = True
            known.update(of=frequent, table=table)
        token = sets.token[order]
        heat = np.zeros(len(token), np.uint64)
        maybe = np.flatnonzero(known["table"][(token >> np.uint64(42)).astype(np.int64)])
        where = np.minimum(np.searchsorted(frequent, token[maybe]), len(frequent) - 1)
        heat[maybe] = np.where(frequent[where] == token[maybe], rank[where], 0)
        hot = np.minimum.reduceat(heat, first)
    by = (owner.astype(np.uint64) << np.uint64(44)) | (hot << np.uint64(38)) | (key >> np.uint64(26))
    order = np.argsort(by)
    by, key, owner = by[order], key[order], owner[order]
    size = np.bincount(owner, minlength=sets.n_texts)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    keep = np.arange(len(key)) - begin[owner] < counts[owner]
    while (more := np.flatnonzero(~keep[1:] & keep[:-1] & (by[1:] == by[:-1]))).size:
        keep[more + 1] = True
    key, owner = key[keep], owner[keep]
    # Where a set has too few segments, its first empty ones come after them.
    lacks = np.flatnonzero((size > 0) & (size < counts))
    if len(lacks):
        more_key, more_owner = [key], [owner]
        for d in lacks.tolist():
            used = distinct[distinct >> np.uint64(40) == d] & np.uint64((1 << 40) - 1)
            some = np.setdiff1d(np.arange(int(counts[d]), dtype=np.uint64), used)[: int(counts[d] - size[d])]
            more_key.append(mix64(mix64(some * np.uint64(64) + np.uint64(bands[d]))))
            more_owner.append(np.full(len(some), d, np.int64))
        key, owner = np.concatenate(more_key), np.concatenate(more_owner)
    return key, owner


def dense_bits(n: int) -> int:
    """Bits of the dense sketch of a set of n, a power of two."""
    return max(64, 1 << (2 * n - 1).bit_length())


def dense_sketches(sets: Sets) -> list[bytes]:
    bits = np.array([dense_bits(n) if n else 0 for n in sets.size.tolist()], np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    at = base[sets.doc] + (mix64(sets.token ^ np.uint64(0x3C3C3C3C3C3C3C3C)) & (bits[sets.doc] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch of fewer bits, by XOR of its parts (bit numbers are taken modulo a power of two)."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sketched(texts: DataFrame, k: int, least_in_chunk: int) -> DataFrame:
    """kind 0: doc_id, n, f1, f2 (a 128-bit print of the set) and the dense sketch,
    row by row.  kind 1: shingles (f1) that a run of texts holds n times, at least `least_in_chunk`."""

    def run(batches):
        names = ["kind", "doc_id", "n", "f1", "f2", "dense"]
        for batch in batches:
            ids = batch.column(0)
            for first, some in _chunks(batch.column(1).to_pylist()):
                sets = Sets(some, k)
                f1, f2 = sets.prints()
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, np.int32)), ids.slice(first, m), pa.array(sets.size.astype(np.int64)), pa.array(f1), pa.array(f2), pa.array(dense_sketches(sets), pa.binary())],
                    names=names,
                )
                value, n = np.unique(sets.token, return_counts=True)
                value, n = value[n >= least_in_chunk], n[n >= least_in_chunk]
                m = len(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(n.astype(np.int64)), pa.array(value.view(np.int64)), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.binary())],
                    names=names,
                )

    return texts.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, f1 long, f2 long, dense binary")


def _frequent(told: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, and ranks that grow with their number.

    The sums over all runs of texts count.  These only order segments, so `most`
    bounds the list without touching any result."""
    counts = told.groupBy("f1").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "f1").limit(most).collect()
    value = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    rank = np.array([min(63, int(r[1]).bit_length()) for r in rows], np.uint64)
    by = np.argsort(value)
    return value[by], rank[by]


def _emit_keys(texts: DataFrame, k: int, need: int, frequent) -> DataFrame:
    """(key, f1): the segments by which a set is found."""
    held = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        value, rank = held.value
        for batch in batches:
            for _, some in _chunks(batch.column(0).to_pylist()):
                sets = Sets(some, k)
                f1, _ = sets.prints()
                # Of copies in one run of texts the first stands for all.
                chosen = np.zeros(len(some), bool)
                chosen[np.unique(f1, return_index=True)[1]] = True
                chosen &= sets.size > 0
                sets = sets.only(chosen)
                n = sets.size.tolist()
                bands = np.array([_band(x) if x else 0 for x in n], np.int64)
                counts = np.array([most_different(x, x * 100 // need, need) + 1 if x else 0 for x in n], np.int64)
                keys, owner = segment_keys(sets, bands, counts, value, rank)
                # Those that may link with a smaller set in the band below are found there as well.
                lower = np.array([x > 0 and b > 0 and _band(max(1, -(-need * x // 100))) < b for x, b in zip(n, bands.tolist())], bool)
                below = [(LOWEST << b >> 1) - 1 for b in bands.tolist()]
                counts = np.array([most_different(x, y, need) + 1 if low else 0 for x, y, low in zip(n, below, lower.tolist())], np.int64)
                more, more_owner = segment_keys(sets.only(lower), np.maximum(bands - 1, 0), counts, value, rank)
                keys, owner = np.concatenate([keys, more]), np.concatenate([owner, more_owner])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(f1[owner])], names=["key", "f1"])

    return texts.select("text").mapInArrow(run, "key long, f1 long")


def _families(keys: DataFrame) -> DataFrame:
    """(fam, f1): for each key that several sets share, its least print as `fam` and every print, itself included; distinct."""

    def run(batches):
        # What is held back of the key that may go on: its least print and its latest one.
        open_key = lead = latest = None
        held: list = []

        def give():
            nonlocal open_key, lead, latest
            key, f = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (f[1:] != f[:-1])
            new[0] = not (key[0] == open_key and f[0] == latest)
            key, f = key[new], f[new]
            if not len(key):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["fam", "f1"])
            begins = np.ones(len(key), bool)
            begins[1:] = key[1:] != key[:-1]
            begins[0] = key[0] != open_key
            leads = f[np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))]
            if not begins[0]:
                leads[key == open_key] = lead
            open_key, lead, latest = key[-1], leads[-1], f[-1]
            pairs = np.unique(np.stack([leads[~begins], f[~begins]]), axis=1)
            pairs = np.concatenate([pairs, np.repeat(np.unique(pairs[0])[None], 2, 0)], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], names=["fam", "f1"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size > 400_000:
                yield give()
                size = 0
        if held:
            yield give()

    ordered = keys.repartition("key").sortWithinPartitions("key", "f1")
    return ordered.mapInArrow(run, "fam long, f1 long").distinct()


def alike(n: np.ndarray, comp: np.ndarray, guest: np.ndarray, dense: list[bytes], need: int):
    """(u, vs) by turns: the members vs of a block that the sketches let member u
    link with.  Pairs of one component and pairs of guests are left out; each pair comes once."""
    width = np.array([len(d) for d in dense], np.int64)
    for w in np.unique(width).tolist():
        # Sizes differ by a third at most, so sketches are as wide or twice as wide.
        x = np.flatnonzero(width == w)
        y = np.flatnonzero((width == w) | (width == 2 * w))
        y = y[np.argsort(width[y], kind="stable")]  # those as wide come first, in the order of x
        bits = np.stack([_fold(np.frombuffer(dense[i], np.uint8), w) for i in y.tolist()]).view(np.uint64)
        step = max(1, (1 << 19) // bits.size)
        for i in range(0, len(x), step):
            u = x[i : i + step]
            both = n[u, None] + n[y]
            most = both - 2 * -(-need * both // (100 + need))
            ok = (comp[u, None] != comp[y]) & ~(guest[u, None] & guest[y]) & (n[u, None] * 100 >= n[y] * need) & (n[y] * 100 >= n[u, None] * need)
            ok &= np.arange(i, i + len(u))[:, None] < np.arange(len(y))
            if ok.any():
                ok &= np.bitwise_count(bits[i : i + len(u), None] ^ bits).sum(2, dtype=np.int64) <= most
                for row in np.flatnonzero(ok.any(1)).tolist():
                    at = y[ok[row]]
                    apart = np.bitwise_count(bits[i + row] ^ bits[ok[row]]).sum(1, dtype=np.int64)
                    yield int(u[row]), at[np.argsort(apart, kind="stable")]


def forest(node, n, comp, guest, dense, need: int, tokens: list | None = None) -> tuple[list, list]:
    """Edges that join the components of a block which alike pairs connect; where
    `tokens` are given, only pairs of enough common shingles."""
    comp = np.unique(comp, return_inverse=True)[1]
    a, b = [], []

    def linked(u, vs):
        if tokens is None or not len(vs):
            return vs
        other = np.concatenate([tokens[v] for v in vs.tolist()])
        mine = tokens[u]
        hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        same = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[vs])[:-1]]), dtype=np.int64)
        return vs[same * 100 >= (n[u] + n[vs] - same) * need]

    def join(u, vs):
        found, first = np.unique(comp[vs], return_index=True)
        for c, v in zip(found.tolist(), vs[first].tolist()):
            if c != comp[u]:
                a.append(node[u])
                b.append(node[v])
        comp[np.isin(comp, found)] = comp[u]

    for u, vs in alike(n, comp.copy(), guest, dense, need):
        # The nearest first: mostly it connects u, and with it all others of that component.
        for some in (slice(0, 1), slice(1, 4), slice(4, None)):
            left = vs[some]
            left = left[comp[left] != comp[u]]
            if len(left := linked(u, left)):
                join(u, left)
    return a, b


#: Members of a family or cluster that every one of its blocks gets.
HUBS = 32
#: Shingles of a block's own members, on average at most.
BLOCK_SHINGLES = 1 << 20


def _dealt(members: DataFrame, comp: DataFrame | None, block: int) -> DataFrame:
    """(fam, block, guest, rep, comp): members (fam, rep, n) dealt to blocks.

    Without `comp`, every member and, as guests of the other blocks, some hubs.
    With it, the components so far, only families of several blocks and several
    components: every member, and as guests all outside the family's largest component."""
    size = members.groupBy("fam").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    blocks = F.greatest(F.ceil(F.sqrt(F.col("c") * 4 / block)), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(2)).cast("int")
    large = size.where((F.col("c") > block) | (F.col("s") > BLOCK_SHINGLES)).select(forget_partitioning(F.col("fam")).alias("f"), "c", blocks.alias("nb"))
    own = lambda salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col("nb")).cast("int")
    on = forget_partitioning(F.col("fam")) == F.col("f")
    if comp is None:
        rows = members.join(large, on, "left").withColumn("nb", F.coalesce("nb", F.lit(1))).withColumn("own", own(1))
        rows = rows.withColumn("comp", F.col("rep"))
        travels = F.pmod(F.xxhash64("rep", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("c") / HUBS))) == 0
    else:
        rows = members.join(large, on).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        rows = rows.withColumn("comp", F.coalesce("component", "rep")).withColumn("own", own(2))
        most = rows.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("fam").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("k"))
        most = most.where("k > 1").select(forget_partitioning(F.col("fam")).alias("g"), "main")
        rows = rows.join(most, forget_partitioning(F.col("fam")) == F.col("g"))
        travels = F.col("comp") != F.col("main")
    places = F.when((F.col("nb") > 1) & travels, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("own"))
    return rows.select("fam", F.explode(places).alias("block"), "own", "rep", "comp").select("fam", "block", (F.col("block") != F.col("own")).alias("guest"), "rep", "comp")


def _forests(rows: DataFrame, need: int, k: int) -> DataFrame:
    """(a, b) of the blocks of `rows`: fam, block, guest, rep, comp and either n and
    dense, or text.  A task holds one block at a time."""
    exact = "text" in rows.columns
    loads = ["text"] if exact else ["n", "dense"]

    def run(batches):
        names = ["fam", "block", "rep", "comp", "guest"]
        key, held = None, []

        def items(batch):
            """(fam, block), node, comp, guest, n, dense, tokens of each row with shingles; a row like the one before it is left out."""
            cols = [batch.column(i).to_pylist() for i in range(5)]
            if not exact:
                yield from zip(*cols, batch.column(5).to_pylist(), batch.column(6).to_pylist(), [None] * len(cols[0]))
                return
            for first, some in _chunks(batch.column(5).to_pylist()):
                sets = Sets(some, k)
                dense = dense_sketches(sets)
                for j, n in enumerate(sets.size.tolist()):
                    if n:
                        yield *(c[first + j] for c in cols), n, dense[j], sets.set_of(j)

        def close():
            if len(held) < 2:
                return [], []
            rep, comp, guest, n, dense, tokens = zip(*held)
            return forest(np.array(rep), np.array(n), np.array(comp), np.array(guest, bool), dense, need, tokens if exact else None)

        for batch in batches:
            a, b = [], []
            for fam, blk, rep, comp, guest, n, dense, tokens in items(batch):
                if (fam, blk) != key:
                    more = close()
                    a += more[0]
                    b += more[1]
                    key, held = (fam, blk), []
                # Rows that repeat an id give its text again.
                if not (held and held[-1][0] == rep and held[-1][3] == n and held[-1][4] == dense):
                    held.append((rep, comp, guest, n, dense, tokens))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select("fam", "block", "rep", "comp", "guest", *loads)
    ordered = rows.repartition("fam", "block").sortWithinPartitions("fam", "block", "rep", *loads[:1])
    return ordered.mapInArrow(run, "a long, b long")


def _settled(members: DataFrame, loaded, extra: DataFrame | None, block: int, need: int, k: int) -> DataFrame:
    """(node, component) by the links within families.  members: fam, rep, n;
    loaded(rows) adds what is compared; `extra` are further edges."""
    edges = checkpointed(_forests(loaded(_dealt(members, None, block)), need, k))
    edges = edges if extra is None else edges.unionByName(extra)
    comp = components(edges)
    rest = checkpointed(_dealt(members, comp, block))
    if rest.isEmpty():
        return comp
    return components(edges.unionByName(checkpointed(_forests(loaded(rest), need, k))))


#: Bits of the map that screens texts before they travel: a fixed size, whatever the input.
MAP_BITS = 1 << 20


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """`rows` with the texts of `rep`.  Only texts that a map of hashed ids lets
    through are dealt out; the map has MAP_BITS places at most, and where it is full it lets everything through."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    wanted = F.broadcast(rows.select(place("rep").alias("place")).distinct())
    some = texts.join(wanted, place("doc_id") == F.col("place"), "left_semi")
    return rows.join(some, rows["rep"] == some["doc_id"]).drop("doc_id")


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, need: int = 75, block: int = 256,
) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of `docs`.  Documents
    link when 100 * |A & B| >= need * |A | B|; component_id is the least id reachable."""
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    told = checkpointed(_sketched(texts, k, 4))
    rows = told.where("kind = 0").drop("kind")
    known = rows.where("n > 0 and doc_id is not null")
    classes = checkpointed(known.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("dense").alias("dense")))
    frequent = _frequent(told.where("kind = 1"), 32, 1 << 18)
    families = checkpointed(_families(_emit_keys(texts, k, need, frequent)).join(classes.select("f1", "rep", "n"), "f1").select("fam", "rep", "n"))

    # Rows of one id with different texts are one document.
    several = known.groupBy("doc_id").agg(F.min("f1").alias("x"), F.max("f1").alias("y")).where("x <> y").select(F.col("doc_id").alias("id"))
    same_id = known.join(several, F.col("doc_id") == F.col("id")).join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    same_id = checkpointed(same_id.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))

    sketches = classes.select(F.col("rep").alias("of"), "n", "dense")
    alike_ = _settled(families, lambda x: x.join(sketches, F.col("rep") == F.col("of")), None, block, need, k)
    sizes = classes.groupBy("rep").agg(F.max("n").alias("n"))
    alike_ = alike_.unionByName(alike_.select(F.col("component").alias("node"), "component").distinct())
    clusters = checkpointed(alike_.join(sizes, F.col("node") == F.col("rep")).select(F.col("component").alias("fam"), "rep", "n"))
    comp = _settled(clusters, lambda x: _with_texts(x, texts), same_id, block, need, k)

    by_rep = classes.select("f1", "f2", "n", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_rep = by_rep.select(*(F.col(c).alias(f"c_{c}") for c in ("f1", "f2", "n")), F.coalesce("component", "rep").alias("component_id"))
    on = (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2")) & (F.col("n") == F.col("c_n"))
    out = rows.drop("dense").join(by_rep, on, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"))
