"""SimHash fingerprints, and groups of documents whose fingerprints differ in few bits.

Fingerprint: A-Z lower-cased, words between ASCII white space, `shingle` words joined by spaces (repeats included; fewer words: all of them; none:
fingerprint zero), XXH64 of each shingle with seed 42; a bit is 1 if it is 1 in over half of them.

Linking (pigeonhole blocks): the 64 bits are cut into b blocks; two fingerprints that differ in at most `bits` bits differ in at most `bits` blocks, so
they share some choice of b - bits whole blocks. There is one key for each such choice. More blocks give longer keys and more of them; b comes
from the number of distinct fingerprints, so that a key of unrelated fingerprints stays rare at any size. Any b is exact.

Skew: equal fingerprints are one row. Keys of up to SMALL fingerprints join themselves in the JVM. Larger ones (many near copies) are cut into chunks by a hash;
every two chunks of a key meet in a task, which finds what is linked there by a search that drops what it has reached, and returns at most a
spanning forest, not all pairs. So no task holds more than two chunks, and rows stay in proportion to the fingerprints.

Cases: null text is empty; rows with null doc_id take part, and their component_id is the smallest doc_id reached, null if there is none; equal
rows each come out; very long texts are read whole, 65536 shingles at a time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import BROADCAST_IDS, WHITE, Scratch, byte_classes, hash_words, mix, shingle_hashes, slices, text_bytes, word_rows
from tracewell.llm.components import components

#: Members of a key that are compared by a plain join.
SMALL = 48
#: A larger key of n members is cut into sqrt(n) / PER_CHUNK chunks: each has PER_CHUNK x sqrt(n) members and is sent to as many tasks as there are chunks.
PER_CHUNK = 8
#: Members that share a key by chance, at most.
CHANCE = 4


def fingerprint(text: str, shingle: int = 4) -> int:
    """Of one text, as unsigned 64 bits."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(line, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory, however long the text
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at + shingle - 1 : at + shingle - 1 + (1 << 16)].tolist())], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fp = np.array([fingerprint(x, shingle) for x in pc.fill_null(batch.column("text"), "").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def key_masks(bits: int, blocks: int) -> list[int]:
    """For each choice of blocks - bits blocks, the mask of their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, blocks - bits)]


def blocks_for(count: int, bits: int) -> int:
    """The fewest blocks whose keys are long enough that unrelated fingerprints seldom share one."""
    b = bits + 1
    while count > CHANCE << (64 // b * (b - bits)) and b < 2 * bits + 4:
        b += 1
    return b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(nodes: np.ndarray, fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct nodes; fps has a row of 64-bit words for each."""
    out = []
    while len(nodes):
        queue, nodes, fps = [(nodes[0], fps[0])], nodes[1:], fps[1:]
        while queue and len(nodes):
            node, fp = queue.pop()
            near = np.bitwise_count(fps ^ fp).sum(axis=1, dtype=np.int64) <= bits
            if near.any():
                out += [(node, x) for x in nodes[near]]
                queue += list(zip(nodes[near], fps[near]))
                nodes, fps = nodes[~near], fps[~near]
    return out


def _forests(words: list[str], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by k, key, i, j."""
        held, last = [], None

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            nodes, first = np.unique(rows[:, 0], return_index=True)
            a, b = np.array(_forest(nodes, rows[first, 1:].view(np.uint64), bits), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("k", "key", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows]
            rows = np.stack([batch.column(c).to_numpy() for c in ("node", *words)], axis=1)
            for a, b in zip(cuts, cuts[1:]):
                if (group := tuple(c[a] for c in cols)) != last and held:
                    yield flush()
                    held = []
                last = group
                held.append(rows[a:b])
        if held:
            yield flush()

    return run


def links(keyed: DataFrame, words: list[str], bits: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between nodes that share a key and whose fingerprints differ in `bits` or fewer bits.

    keyed: k and key (which key, and its value), node, and the fingerprint's 64-bit words; a node has one row a key. All links of a key of up to SMALL nodes are
    returned, and of a larger one a forest that connects what its links connect.
    """
    sizes = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = scratch.write(keyed.join(sizes, ["k", "key"]), "keyed")
    small = keyed.where(F.col("n") <= SMALL)
    sides = [small.select("k", "key", F.col("node").alias(x), *(F.col(w).alias(f"{x}_{w}") for w in words)) for x in ("a", "b")]
    differ = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    pairs = sides[0].join(sides[1], ["k", "key"]).where((F.col("a") < F.col("b")) & (differ <= bits)).select("a", "b")
    large = keyed.where(F.col("n") > SMALL).withColumn("chunks", F.ceil(F.sqrt("n") / PER_CHUNK).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = large.select("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *words)
    forests = large.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j").mapInArrow(_forests(words, bits), "a long, b long")
    return pairs.unionByName(forests).distinct()


def block_keys(fps: DataFrame, count: int, bits: int) -> DataFrame:
    """fps(node, f0, ...) with every key of each fingerprint: all pairs at `bits` or fewer differing bits share one."""
    masks = key_masks(bits, blocks_for(count, bits))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("f0").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]))
    return fps.select(*fps.columns, keys.alias("x")).select(*fps.columns, "x.k", "x.key")


def _grouped(docs: DataFrame, nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """docs(doc_id, node, ...) with component_id, from nodes(node, doc) with each node's smallest doc_id."""
    roots = components(edges, scratch)
    rooted = scratch.write(nodes.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root")), "rooted")
    # a table of its own, or the join would have to take over the aggregate's partitions, where a large component can't be split
    first = scratch.write(rooted.groupBy("root").agg(F.min("doc").alias("component_id")), "first")
    return docs.join(rooted.join(first, "root").select("node", "root", "component_id"), "node")


def near_copies(documents: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.write(fingerprints(documents, shingle).withColumnRenamed("fp", "node"), "fingerprints")
    nodes = scratch.write(docs.groupBy("node").agg(F.min("doc_id").alias("doc")), "distinct")
    keyed = block_keys(nodes.select("node", F.col("node").alias("f0")), nodes.count(), bits)
    return _grouped(docs, nodes, links(keyed, ["f0"], bits, scratch), scratch).select("doc_id", F.col("node").alias("fp"), "component_id")


#: MinHash keys of a text: bands, and rows of each. A pair of similarity 0.8 shares one with a probability of 0.9998.
BANDS, ROWS = 16, 4
#: Two texts are near copies from this Jaccard similarity of their shingles on.
SIMILARITY = 0.8


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """For each slice of rows: the slice, its rows with words, and the ascending distinct shingle hashes of each."""
    for batch in slices(batches, "text"):
        data, offsets = text_bytes(batch.column("text"))
        starts, _, words = hash_words(data, offsets, byte_classes(WHITE))
        first = word_rows(starts, offsets)
        some = np.flatnonzero(np.diff(first))
        yield batch, some, [np.unique(shingle_hashes(words[a:b], min(shingle, b - a))) for a, b in zip(first[some].tolist(), first[some + 1].tolist())]


def _node(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 42)


def set_signatures(documents: DataFrame, shingle: int = 5) -> DataFrame:
    """The columns but `text`, node (a hash of the set of word shingles), size of the set, f0 (the text's fingerprint), and one MinHash key a band. Texts without words are left out."""
    rest = [c for c in documents.columns if c != "text"]
    names = [*rest, "node", "size", "f0", "keys"]
    factors = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 1 << 13):  # bounded memory
            least = np.minimum(least, (h[at : at + (1 << 13)][None, :] * factors).min(axis=1))
        bands = least.reshape(BANDS, ROWS)
        key = mix(bands[:, 0])
        for i in range(1, ROWS):
            key = mix(key ^ bands[:, i])
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, some, sets in _shingles(batches, shingle):
            node = np.array([_node(h) for h in sets], np.uint64).view(np.int64)
            signed = np.array([keys(h) for h in sets], np.uint64).reshape(-1, BANDS).view(np.int64)
            fps = np.array([fingerprint(x, shingle) for x in batch.column("text").take(pa.array(some)).to_pylist()], np.uint64).view(np.int64)
            cols = [*(batch.column(c).take(pa.array(some)) for c in rest), pa.array(node), pa.array([len(h) for h in sets], pa.int64()), pa.array(fps), pa.array(list(signed), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = T.StructType([*documents.select(*rest).schema.fields, *(T.StructField(c, T.LongType()) for c in ("node", "size", "f0")), T.StructField("keys", T.ArrayType(T.LongType()))])
    return documents.select(*rest, "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """node and its shingle hashes, one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, sets in _shingles(batches, shingle):
            node = np.array([_node(h) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, "node long, shingles array<long>")
    return found.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def _set_forest(nodes: np.ndarray, fps: np.ndarray, flat: np.ndarray, first: np.ndarray, similarity: float, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct nodes whose fingerprints differ in at most `bits` bits; node i has the shingles flat[first[i]:first[i + 1]]."""
    size = np.diff(first)
    names, flat = np.unique(flat, return_inverse=True)
    own, left, out = np.zeros(len(names), bool), np.arange(len(nodes)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            at = left[(np.minimum(size[left], size[i]) / np.maximum(size[left], size[i]) >= similarity) & (np.bitwise_count(fps[left] ^ fps[i]) <= bits)]
            if not len(at):
                continue
            own[flat[first[i] : first[i + 1]]] = True
            begin = np.cumsum(size[at]) - size[at]
            index = np.repeat(first[at] - begin, size[at]) + np.arange(int(size[at].sum()))
            shared = np.add.reduceat(own[flat[index]], begin, dtype=np.int64)
            own[flat[first[i] : first[i + 1]]] = False
            near = at[shared / (size[at] + size[i] - shared) >= similarity]
            out += [(nodes[i], nodes[x]) for x in near]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _set_forests(similarity: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by k, key, i, j."""
        held, last = [], None

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            nodes, at = np.unique(rows["node"].to_numpy(), return_index=True)
            sets = rows["shingles"].combine_chunks().take(pa.array(at))
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy())])
            fps = rows["f0"].to_numpy()[at].view(np.uint64)
            a, b = np.array(_set_forest(nodes, fps, sets.flatten().to_numpy(), first, similarity, bits if last[0] >= BANDS else 64), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("k", "key", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows]
            rows = batch.select(["node", "f0", "shingles"])
            for a, b in zip(cuts, cuts[1:]):
                if (group := tuple(c[a] for c in cols)) != last and held:
                    yield flush()
                    held = []
                last = group
                held.append(rows.slice(a, b - a))
        if held:
            yield flush()

    return run


def set_links(nodes: DataFrame, sets_of, similarity: float, bits: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between nodes that share a key and whose sets have a Jaccard similarity of `similarity` or more, by the sets themselves.

    Fingerprints of at most `bits` differing bits meet in their blocks' keys, all of them, and are compared bit by bit; sets whose fingerprints lie further apart meet in `keys`.
    nodes: node, size, f0 and keys, one row a node; sets_of gives node and shingles of a table of nodes. As with links(), a key of over SMALL nodes gives a forest.
    """
    blocks = block_keys(nodes.select("node", "size", "f0"), nodes.count(), bits).withColumn("k", F.col("k") + BANDS)
    keyed = blocks.unionByName(nodes.select("node", "size", "f0", F.posexplode("keys").alias("k", "key")))
    counts = keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = scratch.write(keyed.join(counts, ["k", "key"]), "keyed")
    small = keyed.where(F.col("n") <= SMALL)
    sides = [small.select("k", "key", F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("f0").alias(f"{x}_f0")) for x in ("a", "b")]
    fits = F.least("a_size", "b_size") / F.greatest("a_size", "b_size") >= similarity  # or the similarity is less
    fits &= (F.bit_count(F.col("a_f0").bitwiseXOR(F.col("b_f0"))) <= bits) == (F.col("k") >= BANDS)  # blocks have all pairs of few bits, bands add the others
    pairs = scratch.write(sides[0].join(sides[1], ["k", "key"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct(), "pairs")
    large = keyed.where(F.col("n") > SMALL).withColumn("chunks", F.ceil(F.sqrt("n") / PER_CHUNK).cast("int"))
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    sets = scratch.write(sets_of(needed), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    pairs = both.where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b")
    large = large.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = large.select("k", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "f0").join(sets, "node")
    forests = large.repartition("k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j").mapInArrow(_set_forests(similarity, bits), "a long, b long")
    return pairs.unionByName(forests).distinct()


def similar_copies(documents: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, keep: list[str] | None = None, bits: int = 4) -> DataFrame:
    """doc_id, the columns `keep`, root and component_id: groups of documents linked by a Jaccard similarity of `similarity` or more of their word shingles.

    root is the group itself (the hash of one of its sets), component_id its smallest doc_id, null if there is none. The steps are those of near_copies, with an exact check before the
    groups: fingerprints, pigeonhole blocks, which meet all pairs of `bits` or fewer differing bits, the differing bits themselves, and then the sets of shingles, made again from the texts of
    the nodes that share a key. At 0.8 fingerprints differ in 15 of 100 bits, where no block long enough to be rare is shared for sure; so that no link is lost there, sets whose
    fingerprints differ in more bits meet in MinHash bands as well. Texts without words are no copies of anything.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(keep or []), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    signed = scratch.write(set_signatures(rows, shingle), "signatures")
    nodes = scratch.write(signed.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.min("f0").alias("f0"), F.min("keys").alias("keys")), "distinct")

    def sets_of(needed: DataFrame) -> DataFrame:
        texts = scratch.write(nodes.join(needed, "node", "left_semi").select("text_hash").distinct(), "texts")
        return shingle_sets(rows.select("text", "text_hash").join(F.broadcast(texts) if texts.count() <= BROADCAST_IDS else texts, "text_hash", "left_semi"), shingle)

    edges = set_links(nodes.select("node", "size", "f0", "keys"), sets_of, similarity, bits, scratch)
    return _grouped(signed.select("doc_id", *(keep or []), "node"), nodes.select("node", "doc"), edges, scratch).drop("node")
