"""Alignment of the tokens of two tokenizers, relationally.

Texts are dealt to blocks and cut into units where both tokenizers always end a token, so
that a document's tokens, groups and links are those of its units, one after the other;
a block keeps each unit once, and of the blocks that hold a unit one owns it, where its
tokens, cuts and links are found, once in the corpus.  Tokens of both sides are exploded with their
positions, ends are windowed sums of their lengths in bytes, and an equi-join on unit
and end finds the cuts, where tokens of both end.  The running count of cuts numbers
the groups; the tokens of a group are those between its cut and the one before, and each
of one side is linked to each of the other.  How many documents hold an id pair
linked is counted over the corpus and brought back to the units, then to the documents.

Units, cuts and links lie in tables bucketed by block in the shared folder, so that the
windows and joins that find them run where their block lies.  Shuffled are texts,
units by a 64-bit hash, and what was found of a unit (its id pairs, then its sums and the digits of its
groups), which goes to each block that holds it.

Where a text may be cut follows from the vocabularies: before a space between other
characters, and between two bytes that stand side by side in no token of either, so that no
merge joins them (never beside an apostrophe or white space, which the first
tokenizer's own splitting looks at).

Rules: null and empty texts, and texts whose tokens do not spell them, have no tokens;
repeated rows, and rows without doc_id, are documents of their own; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import CLEANUP, cut, has_checkpoint_dir
from .store import remove
from .words import Words, pieces, spread, text_parts

BLOCK_BYTES, CACHE = 12 << 20, 1_200_000
#: A token is kept as its id and, above these bits, its length in bytes.
ID_BITS = 20
ID = (1 << ID_BITS) - 1
UNITS = "block long, row long, doc_id long, units array<int>, unit int, key long, a array<int>, b array<int>"
#: A stand-in for what comes before a unit without a space: of these one that no token has beside the unit's first byte.
BEFORE = (*b"x#0",)


class Units(Words):
    """Units of space + text; ``between`` tells for two bytes whether a text may be cut there."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, between: np.ndarray):
        data, offs = text_parts(column)
        data, offs = np.insert(data, offs[:-1], 32), offs + np.arange(len(offs))
        n = len(data)
        self.rows, self.offs = len(offs) - 1, offs
        latin = np.zeros(n, dtype=bool)  # the second byte of a Latin-1 letter
        latin[1:] = (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        plain = (data > 32) & (data < 127) | latin
        new = np.zeros(n + 1, dtype=bool)
        new[1 : n - 1] = (data[1:-1] == 32) & plain[:-2] & (data[2:] != 32)
        new[offs[1:] - 1] = False  # a space that ends a text
        new[1:n] |= between[data[:-1], data[1:]] & plain[:-1] & ((plain & ~latin)[1:] | (data[1:] == 0xC3))
        new[offs[:-1]] = True
        new[n:] = False
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], n)[: len(self.start)]
        self.set(data)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


# Fixed value: how byte-level vocabularies of this kind split a text before they merge bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_rank(model: dict, entries: list[bytes], vocab: dict[str, int]):
    """The same byte-pair encoding by ranks, several times as fast for short texts; None unless merges are in the order of ids, which are then their ranks."""
    made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model.get("merges", [])]
    if len(made) + 256 > len(entries) or made != sorted(made) or min(made, default=-1) < 256:
        return None
    try:
        import tiktoken
    except ImportError:
        return None
    ranks = {entries[i]: i for i in [*range(256), *made]}
    return tiktoken.Encoding("by_rank", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Pair:
    """Two tokenizers: a byte-level vocabulary file of tokenizers (A), a sentencepiece model that adds a space (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        s = self.second
        self.bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in range(s.get_piece_size())]
        for table in (self.bytes_a, self.bytes_b):
            if len(table) > ID or max(map(len, table)) >= 1 << (31 - ID_BITS):
                raise ValueError("a vocabulary has too many or too long tokens")
        plain = (file.get("pre_tokenizer") or {}) | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not file.get("normalizer")
        self.ranked = by_rank(file["model"], self.bytes_a, vocab) if plain else None
        beside = np.zeros((256, 256), dtype=bool)
        for x in (*self.bytes_a, *self.bytes_b):
            raw = np.frombuffer(x, dtype=np.uint8)
            beside[raw[:-1], raw[1:]] = True
        #: what may stand before a unit that begins with a byte, and whether there is such
        self.before = np.array([next((s for s in BEFORE if not beside[s, c]), 0) for c in range(256)])
        self.between = ~beside & (self.before > 0)
        self.between[39] = self.between[:, 39] = False
        self.lead = {s: len(self.second.encode(chr(s))) for s in BEFORE}
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int32) for t in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        self.begin = np.zeros((2, 0), dtype=np.int64)
        self.length = np.zeros((2, 0), dtype=np.int64)
        self.good = np.zeros(0, dtype=bool)
        self.flat = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]

    def encode_first(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: Units, key: np.ndarray, at: np.ndarray) -> None:
        place = np.searchsorted(self.key, key)
        known = np.zeros(len(key), dtype=bool)
        inside = place < len(self.key)
        known[inside] = self.key[place[inside]] == key[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        raw = units.data.tobytes()
        own = [raw[a:b] for a, b in zip(units.start[at[new]].tolist(), units.end[at[new]].tolist(), strict=True)]
        texts = [x.decode() for x in own]
        # the model adds a space: it stands for the unit's own, or another character takes it
        before = [0 if x[0] == 32 else int(self.before[x[0]]) for x in own]
        got_b = self.second.encode([chr(s) + t if s else t[1:] for s, t in zip(before, texts, strict=True)], num_threads=1)
        ids = (self.encode_first(texts), [x[self.lead[s] :] if s else x for s, x in zip(before, got_b, strict=True)])
        good = np.ones(len(own), dtype=bool)
        length, begin = np.empty((2, len(own)), dtype=np.int64), np.empty((2, len(own)), dtype=np.int64)
        for side, (got, spell, size) in enumerate(zip(ids, (self.bytes_a, self.bytes_b), (self.size_a, self.size_b), strict=True)):
            good &= np.fromiter((b"".join([spell[i] for i in x]) == t for x, t in zip(got, own, strict=True)), dtype=bool, count=len(own))
            length[side] = [len(x) for x in got]
            flat = np.fromiter((i for x in got for i in x), dtype=np.int32, count=int(length[side].sum()))
            begin[side] = len(self.flat[side]) + np.cumsum(length[side]) - length[side]
            self.flat[side] = np.append(self.flat[side], flat | size[flat] << ID_BITS)
        keys = np.append(self.key, key[new])
        order = np.argsort(keys, kind="stable")
        self.key, self.good = keys[order], np.append(self.good, good)[order]
        self.begin, self.length = np.concatenate([self.begin, begin], axis=1)[:, order], np.concatenate([self.length, length], axis=1)[:, order]

    def units(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct units, as places in what is kept; which of them each unit is; units of each text; whether its tokens spell it)."""
        units = Units(column, self.between)
        key, at, back = np.unique(units.hash, return_index=True, return_inverse=True)
        if len(self.key) + len(key) > CACHE:
            self.clear()
        self.learn(units, key, at)
        place = np.searchsorted(self.key, key)
        bad = np.append(0, np.cumsum(~self.good[place][back]))[units.first]
        good = (np.diff(bad) == 0) & (np.diff(units.offs) > 1)
        return place, back[good[units.row]], np.where(good, units.count, 0), good

    def lists(self, side: int, place: np.ndarray) -> pa.ListArray:
        length = self.length[side][place]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(self.flat[side][spread(self.begin[side][place], length)]))


_pairs: dict[tuple[str, str], Pair] = {}  # of this worker, for all its tasks


def numbered(path_a: str, path_b: str):
    """Rows come sorted by block: each text as the numbers of its units in the block, and each unit once with its tokens."""

    def rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = [("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("units", pa.list_(pa.int32())), ("unit", pa.int32()), ("key", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in kinds], names=[c for c, _ in kinds])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pairs.get((path_a, path_b)) or _pairs.setdefault((path_a, path_b), Pair(path_a, path_b))
        block, known = None, np.zeros(0, np.uint64)
        number = np.zeros(0, np.int32)
        for whole in batches:
            for batch in (x for y in by_block(whole) for x in pieces(y, most=1 << 20)):
                own = batch.column("block")[0].as_py()
                if own != block:
                    block, known, number = own, known[:0], number[:0]
                place, of_text, count, _ = pair.units(batch.column("text"))
                used = np.zeros(len(place), dtype=bool)
                used[of_text] = True
                key = pair.key[place]
                at = np.searchsorted(known, key)
                old = np.zeros(len(key), dtype=bool)
                old[at < len(known)] = known[at[at < len(known)]] == key[at < len(known)]
                new = np.flatnonzero(used & ~old)
                named = np.full(len(key), -1, dtype=np.int32)
                named[old] = number[at[old]]
                named[new] = len(known) + np.arange(len(new))
                known, number = np.append(known, key[new]), np.append(number, named[new])
                order = np.argsort(known, kind="stable")
                known, number = known[order], number[order]
                if len(new):
                    yield rows(len(new), block=pa.array(np.full(len(new), block)), unit=pa.array(named[new]), key=pa.array(key[new].view(np.int64)), a=pair.lists(0, place[new]), b=pair.lists(1, place[new]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(named[of_text]))
                yield rows(batch.num_rows, block=batch.column("block"), row=batch.column("row"), doc_id=batch.column("doc_id"), units=lists)

    return of


def by_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are of one block each."""
    block = batch.column("block").to_numpy(zero_copy_only=False)
    cuts = [*np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)]).tolist(), len(block)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def spelled(a: pa.ListArray, b: pa.ListArray, cuts: pa.ListArray) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each unit: ids of A and B of its groups, from tokens and the places where groups end.

    All at once: the ids in the order unit, group, side, their digits, and after each what separates it from the next.
    """
    unit_of = lambda x: np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    ids, unit, group, side = [], [], [], []
    u = unit_of(cuts)
    for k, (tokens, name) in enumerate(((a, "a_to"), (b, "b_to"))):
        own = unit_of(tokens)
        begin = (tokens.offsets.to_numpy() - tokens.offsets[0].as_py()).astype(np.int64)
        stops = begin[u] + cuts.flatten().field(name).to_numpy()  # rising over all units
        ids.append(tokens.flatten().to_numpy() & ID)
        unit.append(own)
        group.append(np.searchsorted(stops, np.arange(len(own)), side="right"))
        side.append(np.full(len(own), k))
    ids, unit, group, side = (np.concatenate(x) for x in (ids, unit, group, side))
    order = np.lexsort((side, group))
    ids, unit, group, side = ids[order], unit[order], group[order], side[order]
    size = np.searchsorted(10 ** np.arange(1, 10), ids, side="right") + 1
    stop = np.cumsum(size + 1)
    out = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
    left = ids.copy()
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[stop[on] - 2 - k] = 48 + left[on] % 10
        left //= 10
    same = np.append(group[1:] == group[:-1], False)[: len(group)]
    turn = same & (np.append(side[1:] != side[:-1], False)[: len(side)])
    out[stop - 1] = np.where(turn, ord("|"), np.where(same, ord(","), ord(";")))
    ends = np.append(0, stop)[np.searchsorted(unit, np.arange(len(a) + 1))]
    raw = out.tobytes()
    return [raw[x : y - 1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
DIGESTS = "doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string"
SPELLED = "block long, key long, text binary, " + ", ".join(f"{c} long" for c in SUMS)


def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units as their groups are written, with their sums."""
    for batch in batches:
        text = spelled(batch.column("a"), batch.column("b"), batch.column("cuts"))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("key"), pa.array(text, pa.binary()), *(batch.column(c) for c in SUMS)], names=["block", "key", "text", *SUMS])


def put_together(docs: pa.Table, units: pa.Table) -> pa.Table:
    """Documents of one block from its units: sums, and the digest of all groups in order."""
    units = units.sort_by("unit")  # numbered from 0 without a gap
    text = units.column("text").to_pylist()
    values = [units.column(c).to_numpy() for c in SUMS]
    got: dict[str, list] = {"sha": [], **{c: [] for c in SUMS}}
    for chunk in docs.column("units").chunks:
        offs, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            own = flat[a:b]
            got["sha"].append(hashlib.sha256(b";".join([text[i] for i in own.tolist()])).hexdigest() if b > a else "")
            for c, v in zip(SUMS, values, strict=True):
                got[c].append(int(v[own].sum()))
    arrays = [docs.column("doc_id").combine_chunks(), *(pa.array(got[c], pa.int64()) for c in SUMS), pa.array(got["sha"], pa.string())]
    return pa.Table.from_arrays(arrays, names=["doc_id", *SUMS, "groups_sha256"])


def block_labels(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each of ``blocks`` buckets, in their order, that Spark's bucketing puts there."""
    found: dict[int, int] = {}
    most = 16 * blocks
    while len(found) < blocks:
        ids = spark.range(most).groupBy(F.expr(f"pmod(hash(id), {blocks})").alias("at")).agg(F.min("id").alias("id"))
        found = {r["at"]: r["id"] for r in ids.collect()}
        most *= 4
    return [found[k] for k in range(blocks)]


#: While this module's jobs run: a table bucketed by block serves joins on more columns, sorted rows are collected without a hash table, and shuffle files go with the job they are of.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.replaceHashWithSortAgg": "true", CLEANUP: "true"}


@contextlib.contextmanager
def settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Kept:
    """Tables of one run in the shared folder, bucketed by block."""

    def __init__(self, spark: SparkSession, blocks: int):
        self.spark, self.blocks, self.names = spark, blocks, []
        self.name = f"align_{uuid.uuid4().hex}"
        self.root = f"{has_checkpoint_dir(spark).rstrip('/')}/{self.name}"

    def put(self, df: DataFrame, what: str) -> DataFrame:
        name = f"{self.name}_{what}"
        df.write.format("parquet").option("compression", "zstd").bucketBy(self.blocks, "block").option("path", f"{self.root}/{what}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self, *what: str) -> None:
        """Drop tables that nothing reads any more."""
        for x in what:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{x}")
            with contextlib.suppress(OSError):
                remove(f"{self.root}/{x}")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        with contextlib.suppress(OSError):
            remove(self.root)


def ends(units: DataFrame, side: str) -> DataFrame:
    """(block, unit, end, <side>_to) of each token: bytes and tokens of its unit up to its end."""
    each = units.select("block", "unit", F.posexplode(side).alias("pos", "code"))
    so_far = Window.partitionBy("block", "unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return each.select("block", "unit", F.sum(F.shiftright("code", ID_BITS)).over(so_far).alias("end"), (F.col("pos") + 1).alias(f"{side}_to"))


def cut_lists(units: DataFrame) -> DataFrame:
    """Per unit its cuts (group, a_to, b_to): where its groups end in the tokens of A and of B."""
    both = ends(units, "a").join(ends(units, "b").hint("merge"), ["block", "unit", "end"])
    so_far = Window.partitionBy("block", "unit").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    grouped = both.select("block", "unit", F.count("*").over(so_far).cast("int").alias("group"), "a_to", "b_to")
    return grouped.groupBy("block", "unit").agg(F.sort_array(F.collect_list(F.struct("group", "a_to", "b_to"))).alias("cuts"))


def pairs_of(units: DataFrame) -> DataFrame:
    """(block, unit, a, b, n): linked id pairs of each unit and how often they are, from tokens with cuts."""

    def ids(side: str, i, c):
        # the cut before ends where this group begins
        begin = F.when(i == 0, 0).otherwise(F.get(F.col("cuts"), i - 1)[f"{side}_to"])
        return F.slice(side, begin + 1, c[f"{side}_to"] - begin)

    groups = units.select("block", "unit", F.explode(F.transform("cuts", lambda c, i: F.struct(ids("a", i, c).alias("a"), ids("b", i, c).alias("b")))).alias("g"))
    links = groups.select("block", "unit", F.explode("g.a").alias("a"), F.col("g.b").alias("bs")).select("block", "unit", "a", F.explode("bs").alias("b"))
    links = links.select("block", "unit", F.col("a").bitwiseAND(ID).alias("a"), F.col("b").bitwiseAND(ID).alias("b"))
    return links.groupBy("block", "unit", "a", "b").agg(F.count("*").alias("n"))


def distinct_units(units: DataFrame) -> DataFrame:
    """Each unit of the corpus once: of the blocks that hold it one, drawn by hash, keeps it."""
    owner = units.groupBy("key").agg(F.min_by("block", F.xxhash64("key", "block")).alias("block"))
    return units.join(owner.hint("shuffle_hash"), ["block", "key"])


def at_blocks(units: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """What was ``found`` of each unit (by key), for every block that holds it, dealt by block."""
    return units.select("block", "unit", "key").join(found.hint("shuffle_hash"), "key").drop("key").repartition(blocks, "block")


def held_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(block, a, b, own): how many documents of a block hold an id pair linked; ``pairs`` has rows of a and b, or each unit's as one list of ``codes``."""
    inside = docs.select("block", "row", F.explode(F.array_distinct("units")).alias("unit"))
    if "codes" not in pairs.columns:
        pairs = pairs.select("block", "unit", F.array(code_of("a", "b")).alias("codes"))
    each = inside.join(pairs.hint("shuffle_hash"), ["block", "unit"]).select("block", "row", F.explode("codes").alias("code")).distinct()
    held = each.groupBy("block", "code").agg(F.count("*").alias("own"))
    return held.select("block", F.shiftright("code", ID_BITS).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(ID).cast("long")).cast("int").alias("b"), "own")


def code_of(a: str, b: str):
    return F.shiftleft(F.col(a).cast("long"), ID_BITS).bitwiseOR(F.col(b).cast("long"))


def counted(held: DataFrame) -> DataFrame:
    """(a, b, docs, best) of each id pair: documents of the corpus that hold it, and whether no pair of its A id has more."""
    count = held.groupBy("a", "b").agg(F.sum("own").alias("docs"))
    most = count.groupBy("a").agg(F.max("docs").alias("most"))
    return count.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    size, n = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    kept = Kept(spark, max(1, math.ceil(((size or 0) + 64 * n) / block_bytes)))
    try:
        with settings(spark):
            labels = F.array(*[F.lit(x) for x in block_labels(spark, kept.blocks)])
            rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
            rows = rows.select(F.get(labels, F.pmod(F.xxhash64("row"), F.lit(kept.blocks)).cast("int")).cast("long").alias("block"), "*")
            both = kept.put(rows.repartition(kept.blocks, "block").sortWithinPartitions("block").mapInArrow(numbered(path_a, path_b), UNITS), "units")
            texts, units = both.filter("row IS NOT NULL").select("block", "row", "doc_id", "units"), both.filter("unit IS NOT NULL").select("block", "unit", "key", "a", "b")
            own = kept.put(distinct_units(units), "own").select("block", "unit", "key", "a", "b")
            own = own.join(kept.put(cut_lists(own), "cuts").hint("merge"), ["block", "unit"])
            pairs = kept.put(pairs_of(own), "pairs")
            codes = pairs.groupBy("block", "unit").agg(F.collect_list(code_of("a", "b")).alias("codes"))
            codes = own.select("block", "unit", "key").join(codes.hint("merge"), ["block", "unit"]).select("key", "codes")
            held = kept.put(held_pairs(texts, at_blocks(units, codes, kept.blocks)), "held")
            known = pairs.join(counted(held), ["a", "b"]).select("block", "unit", "n", "docs", "best").repartition(kept.blocks, "block")
            sums = known.groupBy("block", "unit").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
            sizes = [F.size(c).cast("long").alias(f"n_{k}") for c, k in (("a", "a"), ("b", "b"), ("cuts", "groups"))]
            found = own.join(sums.hint("merge"), ["block", "unit"]).select("block", "key", "a", "b", "cuts", *sizes, "n_links", "n_best", "count_sum")
            found = kept.put(found.mapInArrow(spell, SPELLED), "found").drop("block")
            kept.forget("own", "cuts", "pairs", "held")  # before the largest step
            placed = at_blocks(units, found, kept.blocks)
            return cut(texts.withColumnRenamed("block", "at").groupBy("at").cogroup(placed.groupBy("block")).applyInArrow(put_together, DIGESTS))
    finally:
        kept.drop()
