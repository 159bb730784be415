"""Documents linked by the Jaccard similarity of their word n-grams, by a token-group matrix.

1. Each text becomes a set of hashed n-grams. The hash space is cut into 2**k equal parts, k by the
   set's size, so that two sets similar enough differ in clearly fewer parts than there are. The hash
   of each part is a signature, and a set needs a certain number of signatures that others have too,
   to be similar to any. No similar pair is missed, no frequent n-gram makes a large bucket by itself,
   and a passage in common does not make a candidate.
2. Candidates that share a signature form families. A family's distinct sets are dealt out to blocks of
   bounded size.
3. In a block, similar sets are partitioned into groups (by least n-gram) and the matrix of n-grams
   against groups stores each group's union. The overlap of a set with a union bounds its overlap
   with every member; only qualifying groups are opened, and members not yet connected compared.
4. Families larger than a block are connected through a few pivots present in all their blocks. What
   stays apart is then compared with every block of the family. Copies count as one set throughout.

Only families are shuffled with their n-grams; all other texts leave signatures only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from delayfold.llm import arrays
from delayfold.llm.graph import components
from delayfold.llm.tables import each_group, stored


@dataclass(frozen=True)
class Similarity:
    """Sets link when den * intersection >= num * union; words are made of `size` words."""

    size: int = 5
    num: int = 80
    den: int = 100

    def smallest_partner(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.num // self.den)

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num

    def needed(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Least intersection of linked sets of sizes n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def differing(self, both: np.ndarray) -> np.ndarray:
        """Most elements that only one of two linked sets has, given the sum of their sizes."""
        return (self.den - self.num) * both // (self.den + self.num)


# ---------------------------------------------------------------- sets and signatures


def _word_sets(chunk: arrays.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, back to back, and their bounds."""
    data = arrays.ascii_lower(chunk.data)
    words = arrays.split_words(data, chunk.offsets)
    hashes = arrays.RangeHash(data)(words.starts, words.ends)
    counts = words.counts
    n_grams = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n_grams)])
    doc = np.repeat(np.arange(len(chunk)), n_grams)
    at = words.first[doc] + np.arange(bounds[-1]) - bounds[doc]
    length = np.minimum(counts, size)[doc]
    grams = length.astype(np.uint64)
    for i in range(size):
        inside = i < length
        word = hashes[np.where(inside, at + i, 0)] if len(hashes) else grams
        grams = arrays.mix(np.where(inside, grams * np.uint64(0x9E3779B97F4A7C15) + word, grams))
    for low, high in zip(bounds[:-1], bounds[1:]):
        grams[low:high].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(arrays.sums_of(new, bounds))])


def _wrapped_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _set_keys(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal sets."""
    high = _wrapped_sums(arrays.mix(grams), bounds)
    low = _wrapped_sums(arrays.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    return high.view(np.int64), low.view(np.int64)


def _level(n: np.ndarray, rule: Similarity) -> np.ndarray:
    """k such that 2**k parts are half as many again as two linked sets of at most n elements can differ in."""
    differing = rule.differing(2 * n)
    return np.ceil(np.log2(np.where(differing > 0, 1.5 * (differing + 1), 1))).astype(np.int64)


def _largest_of_level(level: int, rule: Similarity) -> int:
    """Largest set size with at most this level."""
    if level == 0:
        return int(np.flatnonzero(rule.differing(2 * np.arange(1000)) == 0)[-1])
    most = int((1 << level) / 1.5 + 1e-9) - 1  # differing elements
    n = (most + 1) * (rule.den + rule.num) // (2 * (rule.den - rule.num)) + 2
    while rule.differing(2 * n) > most:
        n -= 1
    return n


@dataclass
class _Signed:
    """Signatures of sets: owners and marks, and for each (set, level) how many marks must be shared."""

    owners: np.ndarray
    marks: np.ndarray
    needing: np.ndarray
    needs: np.ndarray


def _signatures(grams: np.ndarray, bounds: np.ndarray, rule: Similarity) -> _Signed:
    """Marks of all parts that are not empty, at every level a partner may use. The low five bits of a
    mark are its level, as are those of a need."""
    n = np.diff(bounds)
    partner = rule.largest_partner(n)
    low, high = _level(n, rule), _level(partner, rule)
    owners, marks, needing, needs = [], [], [], []
    unsafe = np.zeros(len(n), bool)
    mixed = arrays.mix(grams ^ np.uint64(0x2545F4914F6CDD1D))
    level = 0
    while level <= high.max(initial=0) or unsafe.any():
        sets = np.flatnonzero((n > 0) & (((low <= level) & (level <= high)) | unsafe))
        if not len(sets):
            level += 1
            continue
        lengths = n[sets]
        within = np.repeat(bounds[sets] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        take = within + np.arange(lengths.sum())
        owner = np.repeat(sets, lengths)
        values = grams[take]
        part = values >> np.uint64(64 - level) if level else np.zeros(len(values), np.uint64)
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        content = _wrapped_sums(mixed[take], np.append(starts, len(part)))
        place = arrays.mix(part[starts] + np.uint64(level << 48) + np.uint64(1))
        owners.append(owner[starts])
        marks.append((arrays.mix(content ^ place) & ~np.uint64(31)) | np.uint64(level))
        # Of the parts that are not empty here, all but those that differ are a linked partner's too. If
        # that may be none, both also sign a level up, where fewer parts are empty for their number.
        filled = np.bincount(owner[starts], minlength=len(n))
        shared = filled - rule.differing(n + np.minimum(partner, _largest_of_level(level, rule)))
        needing.append(sets)
        needs.append((np.maximum(shared[sets], 1) << 5) | level)
        unsafe = np.zeros(len(n), bool)
        unsafe[sets] = shared[sets] < 1
        level += 1
    if not owners:
        nothing = np.zeros(0, np.int64)
        return _Signed(nothing, nothing.view(np.uint64), nothing, nothing)
    owner, mark, who, need = (np.concatenate(x) for x in (owners, marks, needing, needs))
    order = np.argsort(who, kind="stable")
    return _Signed(owner, mark, who[order], need[order])


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _describe(rule: Similarity):
    """Size and key of each set, and what its signatures must fulfil."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            grams, bounds = _word_sets(chunk, rule.size)
            high, low = _set_keys(grams, bounds)
            signed = _signatures(grams, bounds, rule)
            per_set = np.searchsorted(signed.needing, np.arange(len(chunk) + 1))
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    _long(np.diff(bounds)),
                    _long(high),
                    _long(low),
                    arrays.list_rows(pa.array(signed.needs.astype(np.int32)), per_set),
                ],
                ["doc_id", "n_shingles", "set_high", "set_low", "needs"],
            )

    return run


_SIGNED_BYTES = 1 << 19  # of text; its marks take many times as much


def _sign(rule: Similarity):
    """One row for each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches, limit=_SIGNED_BYTES):
            signed = _signatures(*_word_sets(chunk, rule.size), rule)
            docs = chunk.column("doc_id").take(pa.array(signed.owners))
            yield pa.record_batch([_long(signed.marks), docs], ["mark", "doc_id"])

    return run


_SET = "n_shingles long, set_high long, set_low long"


def _fetch(rule: Similarity):
    """The sets themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.text_chunks(batches):
            grams, bounds = _word_sets(chunk, rule.size)
            high, low = _set_keys(grams, bounds)
            yield pa.record_batch(
                [
                    chunk.column("doc_id"),
                    _long(np.diff(bounds)),
                    _long(high),
                    _long(low),
                    arrays.binary_rows(grams, bounds),
                ],
                ["doc_id", "n_shingles", "set_high", "set_low", "grams"],
            )

    return run


# ---------------------------------------------------------------- the matrix of one block


def links_within(
    ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, rule: Similarity
) -> list[tuple[int, int]]:
    """Links that connect what is connected, for sets that `label` does not yet put together."""
    n = np.array([len(s) for s in sets], np.int64)
    keep = np.flatnonzero(n > 0)
    if len(keep) < 2:
        return []
    ids, label, n = ids[keep], label[keep], n[keep]
    sets = [sets[i] for i in keep]
    tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(n)])
    least = np.minimum.reduceat(local, bounds[:-1])
    order = np.lexsort((n, least))  # members of a group next to each other
    sets_local = [local[bounds[i] : bounds[i + 1]] for i in order]
    ids, label, n, least = ids[order], label[order], n[order], least[order]
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(n))
    smallest = np.minimum.reduceat(n, first)
    largest = np.maximum.reduceat(n, first)
    matrix = np.zeros((len(tokens), len(first)), bool)
    for g, (low, high) in enumerate(zip(first, last)):
        for i in range(low, high):
            matrix[sets_local[i], g] = True

    parent = np.unique(label, return_inverse=True)[1].astype(np.int64)

    links: list[tuple[int, int]] = []
    mark = np.zeros(len(tokens), bool)
    for q in range(len(n)):
        overlap = matrix[sets_local[q]].sum(axis=0, dtype=np.int64)
        least_size = np.maximum(smallest, rule.smallest_partner(n[q]))
        opened = (
            (overlap >= rule.needed(n[q], least_size))
            & (largest >= rule.smallest_partner(n[q]))
            & (smallest <= rule.largest_partner(n[q]))
            & (first <= q)
        )
        mark[sets_local[q]] = True
        for g in np.flatnonzero(opened):
            for x in range(first[g], min(last[g], q)):
                if parent[x] == parent[q]:
                    continue
                shared = int(mark[sets_local[x]].sum())
                if shared >= rule.needed(n[q], n[x]):
                    links.append((int(ids[q]), int(ids[x])))
                    parent[parent == parent[q]] = parent[x]
        mark[sets_local[q]] = False
    return links


def _block_links(rule: Similarity, keys: list[str], labelled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_group(batches, keys):
            ids = rows.column("doc_id").to_numpy()
            label = rows.column("label").to_numpy() if labelled else ids
            sets = [np.frombuffer(b, np.uint64) for b in rows.column("grams").to_pylist()]
            links = links_within(ids, sets, label, rule)
            if links:
                a, b = zip(*links)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


# ---------------------------------------------------------------- the job


def _linked_blocks(rows: DataFrame, keys: list[str], rule: Similarity, labelled: bool) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_block_links(rule, keys, labelled), "a long, b long")


def similar_documents(
    docs: DataFrame,
    rule: Similarity = Similarity(),
    block: int = 256,
    pivots: int = 8,
) -> DataFrame:
    """doc_id, n_shingles, set_high, set_low, component_id of every row of `docs`.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z. A text with fewer
    words than an n-gram is one n-gram. Texts that are null or have no word are empty sets, and link
    with nothing, nor do rows without doc_id (their component is their doc_id). Rows that share a
    doc_id are one node. `set_high`, `set_low` and `n_shingles` together name the distinct set, so
    copies are listed by membership and never as pairs. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stored(texts.mapInArrow(_describe(rule), f"doc_id long, {_SET}, needs array<int>"), "sets")
    named = sets.where("doc_id is not null and n_shingles > 0")

    signed = texts.where("doc_id is not null").mapInArrow(_sign(rule), "mark long, doc_id long")
    families = _families(_candidates(signed, named))

    members = stored(named.drop("needs").join(families, "doc_id"), "members")
    set_columns = ["family", "n_shingles", "set_high", "set_low"]
    distinct_sets = members.groupBy(*set_columns).agg(F.min("doc_id").alias("doc_id"))
    copies = (
        members.join(distinct_sets.withColumnRenamed("doc_id", "first"), set_columns)
        .where("doc_id != first")
        .select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    )
    sizes = distinct_sets.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    asked = distinct_sets.join(sizes, "family")
    # The ids alone first: a short list is broadcast by Spark, a long one shuffles the texts.
    ids = stored(asked.select("doc_id").distinct(), "ids")
    fetched = texts.join(ids, "doc_id", "left_semi").mapInArrow(
        _fetch(rule), f"doc_id long, {_SET}, grams binary"
    )
    grams = stored(
        fetched.join(asked, ["doc_id", "n_shingles", "set_high", "set_low"]).select(
            "family", "members", "doc_id", "n_shingles", "grams"
        ),
        "grams",
    )
    grams = _split_large_families(grams, rule, block)

    blocks = F.ceil(F.col("members") / block)
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    small = grams.withColumn("block", own)
    top = Window.partitionBy("family").orderBy(F.xxhash64("doc_id"), "doc_id")
    everywhere = (
        grams.where(F.col("members") > block)
        .withColumn("place", F.row_number().over(top))
        .where(F.col("place") <= pivots)
        .drop("place")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    )
    first_links = stored(
        _linked_blocks(small.union(everywhere.select(small.columns)), ["family", "block"], rule, False),
        "links",
    )

    rest_links = _links_of_large_families(grams.where(F.col("members") > block), first_links, rule, block)
    links = copies.union(first_links)
    found = components(links if rest_links is None else links.union(rest_links))
    return (
        sets.drop("needs")
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            "set_high",
            "set_low",
            F.coalesce("component", "doc_id").alias("component_id"),
        )
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by mark: those next to one with the same mark. The first and last of a partition
    stay too, as their mark may go on in another."""
    held: pa.RecordBatch | None = None
    opened = False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        marks = rows.column("mark").to_numpy()
        same = np.zeros(len(marks) + 1, bool)
        same[1:-1] = marks[1:] == marks[:-1]
        keep = same[1:] | same[:-1]
        keep[0] |= not opened
        start = 1 if opened and held is not None else 0
        # The last row waits: with the one before it, to be judged when its next one is known.
        if len(marks) > 1:
            yield rows.slice(start, len(marks) - 1 - start).filter(pa.array(keep[start:-1]))
            opened = True
            held = rows.slice(len(marks) - 2)
        else:
            held = rows
    if held is not None:
        yield held.slice(held.num_rows - 1)


def _candidates(signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(mark, doc_id) of the documents that share as many signatures of a level as a link would need."""
    shared = stored(
        signed.repartitionByRange("mark", "doc_id")
        .sortWithinPartitions("mark", "doc_id")
        .mapInArrow(_repeated, "mark long, doc_id long"),
        "shared",
    ).withColumn("level", F.col("mark").bitwiseAND(31))
    need = sets.select("doc_id", F.explode("needs").alias("need")).select(
        "doc_id", F.col("need").bitwiseAND(31).cast("long").alias("level"), F.shiftright("need", 5).alias("need")
    )
    least = need.groupBy("doc_id", "level").agg(F.min("need").alias("need"))
    enough = (
        shared.groupBy("doc_id", "level")
        .agg(F.count("*").alias("n"))
        .join(least, ["doc_id", "level"])
        .where("n >= need")
        .select("doc_id", "level")
    )
    return shared.join(enough, ["doc_id", "level"], "left_semi").select("mark", "doc_id")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by mark and doc_id: each document with the first one of its mark.

    The first and last mark of a partition may go on in another; they are also told, with the first
    document they have here (b is null).
    """
    names = ["mark", "a", "b"]
    mark, lead, opened = None, None, False
    for batch in batches:
        marks, docs = batch.column("mark").to_numpy(), batch.column("doc_id").to_numpy()
        if not len(marks):
            continue
        new = np.ones(len(marks), bool)
        new[1:] = marks[1:] != marks[:-1]
        new[0] = mark is None or marks[0] != mark
        starts = np.flatnonzero(new)
        run = np.cumsum(new)
        leads = np.concatenate([[docs[0] if lead is None else lead], docs[starts]])[run]
        linked = docs != leads
        yield pa.record_batch(
            [pa.array(marks[linked]), pa.array(docs[linked]), pa.array(leads[linked])], names
        )
        if not opened:
            yield pa.record_batch([[marks[0]], [leads[0]], pa.array([None], pa.int64())], names)
            opened = True
        mark, lead = marks[-1], leads[-1]
    if opened:
        yield pa.record_batch([[mark], [lead], pa.array([None], pa.int64())], names)


def _families(marked: DataFrame) -> DataFrame:
    """doc_id and family of all documents that are connected by equal marks.

    Rows are dealt by ranges of (mark, document), so a mark with a large part of the rows is spread
    over many tasks, and each task reads its share as a stream.
    """
    found = stored(
        marked.repartitionByRange("mark", "doc_id")
        .sortWithinPartitions("mark", "doc_id")
        .mapInArrow(_stars, "mark long, a long, b long"),
        "stars",
    )
    ends = found.where("b is null").select("mark", "a").distinct()
    firsts = ends.groupBy("mark").agg(F.min("a").alias("b"))
    stars = found.where("b is not null").select("a", "b").distinct()
    across = ends.join(firsts, "mark").where("a != b").select("a", "b")
    return components(stars.union(across)).select(
        F.col("node").alias("doc_id"), F.col("component").alias("family")
    )


def _as_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            values = np.frombuffer(batch.column("grams")[row].as_py(), np.int64)
            yield pa.record_batch(
                [
                    pa.array(values),
                    pa.array(np.full(len(values), batch.column("doc_id")[row].as_py())),
                    pa.array(np.full(len(values), batch.column("n_shingles")[row].as_py())),
                ],
                ["gram", "doc_id", "n_shingles"],
            )


def _split_large_families(grams: DataFrame, rule: Similarity, block: int) -> DataFrame:
    """Families of more than a block, split by their rarest n-grams.

    Signatures of small sets may bring documents together that only share a passage. Ordered from
    rare to frequent, two linked sets have one of their first n - ceil(n * num / den) + 1 n-grams in
    common; what has none is no family.
    """
    large = grams.where(F.col("members") > block)
    if large.isEmpty():
        return grams
    listed = large.mapInArrow(_as_longs, "gram long, doc_id long, n_shingles long")
    counts = listed.groupBy("gram").agg(F.count("*").alias("frequency"))
    ordered = (
        listed.join(counts, "gram")
        .groupBy("doc_id", "n_shingles")
        .agg(F.sort_array(F.collect_list(F.struct("frequency", "gram"))).alias("order"))
    )
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * rule.num / rule.den) + 1
    first = ordered.select(
        F.explode(F.slice("order", 1, prefix.cast("int"))).alias("rare"), "doc_id"
    ).where("rare.frequency > 1")
    families = _families(first.select(F.col("rare.gram").alias("mark"), "doc_id"))
    moved = large.drop("family", "members").join(families, "doc_id")
    sizes = moved.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    again = moved.join(sizes, "family").select(grams.columns)
    return stored(grams.where(F.col("members") <= block).union(again), "grams")


def _links_of_large_families(
    grams: DataFrame, links: DataFrame, rule: Similarity, block: int
) -> DataFrame | None:
    """Links between the parts of families that fill more than one block.

    The largest connected part of a family stays where it is, once for each block of the others; the
    others are compared with all of the family, block by block.
    """
    if grams.isEmpty():
        return None
    found = components(links).withColumnRenamed("node", "doc_id")
    labels = grams.select("family", "doc_id").join(found, "doc_id", "left").select(
        "family", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    parts = labels.groupBy("family", "label").agg(F.count("*").alias("size"))
    main = parts.groupBy("family").agg(
        F.max(F.struct("size", "label")).alias("main"), F.sum("size").alias("all")
    )
    plan = main.where("main.size < all").select(
        "family",
        F.col("main.label").alias("main_label"),
        F.ceil(F.col("main.size") / block).alias("main_blocks"),
        F.ceil((F.col("all") - F.col("main.size")) / block).alias("other_blocks"),
    )
    rows = grams.join(labels, ["family", "doc_id"]).join(plan, "family")
    in_main = F.col("label") == F.col("main_label")
    hashed = F.xxhash64("doc_id", F.lit(1))
    # Blocks of the main part are numbered after those of the others; a task is a pair of blocks.
    mine = F.when(in_main, F.col("other_blocks") + F.pmod(hashed, "main_blocks")).otherwise(
        F.pmod(hashed, "other_blocks")
    )
    until = F.when(in_main, F.col("other_blocks")).otherwise(F.col("other_blocks") + F.col("main_blocks"))
    tasks = (
        rows.withColumn("mine", mine)
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), until - 1)))
        .select(
            "family",
            F.least("mine", "with").alias("one"),
            F.greatest("mine", "with").alias("other"),
            "doc_id",
            "label",
            "grams",
        )
    )
    return stored(_linked_blocks(tasks, ["family", "one", "other"], rule, True), "links")


def deduplicated(docs: DataFrame, rule: Similarity = Similarity()) -> DataFrame:
    """`docs` with one document of each component, that of the smallest doc_id; documents without links stay.

    Rows that share a doc_id but not their text are documents of their own, of which none stands for others
    if one with a doc_id to itself can; of rows that repeat both, one stays. Rows without doc_id stay.
    """
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    counted = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(counted.select("doc_id"), "repeated")
    if repeated.isEmpty():
        found = similar_documents(named, rule)
        linked = stored(found.where("component_id != doc_id").select("doc_id").distinct(), "linked")
        return named.join(linked, "doc_id", "left_anti").select(*docs.columns).union(nameless)
    shares = F.col("r.doc_id").isNotNull()
    # Such a document goes by a hash of both, beyond the usual ids.
    own = F.xxhash64("d.doc_id", "d.text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    marked = named.alias("d").join(repeated.alias("r"), F.col("d.doc_id") == F.col("r.doc_id"), "left")
    keyed = marked.select(
        F.when(shares, own).otherwise(F.col("d.doc_id")).alias("key"),
        shares.alias("shares"),
        F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"),
    )
    once = keyed.where("not shares").union(keyed.where("shares").dropDuplicates(["key"]))
    found = similar_documents(once.select(F.col("key").alias("doc_id"), "row.text"), rule)
    linked = stored(found.where("component_id != doc_id").select(F.col("doc_id").alias("key")).distinct(), "linked")
    kept = once.join(linked, "key", "left_anti").select("row.*")
    return kept.union(nameless)
