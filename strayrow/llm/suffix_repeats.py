"""Repeated passages by the interval tree of enhanced suffix arrays, and their removal.

Suffixes are dealt so that equal beginnings meet. Every window of ``least`` bytes has an anchor, the
k-gram in it with the smallest hash, and equal windows have equal anchors; the windows of one anchor
in one place make a piece of text of less than twice that length. Equal windows have their anchor at
the same distance, so those of one piece all differ: an anchor with a single place cannot repeat, and
its piece stays where it is. All other pieces go to the bucket of their anchor, equal ones of a block
of documents once, with the smallest id there; their places stay in the block. The removal compares
documents only, so there the pieces of an anchor found in a single document stay as well.

In a bucket the suffixes of its pieces are sorted, the lengths of common prefixes of neighbours
computed, and a scan with a stack builds the tree of common-prefix intervals. An interval is a
repeat that cannot be longer to the right; it is reported if what stands to the left of its members
differs, or is the end of a piece for any of them, so that it cannot be longer to the left either.
Reports go back to the blocks, which apply them to all places of a piece, those of nested intervals
included. Passages longer than a piece are reported as overlapping repeats, whose union is the whole
passage.

An anchor of a great many different pieces (the end of a passage that very many documents share) is
split: every window of the pieces reaches further to one side of the anchor than to the other, so
half of them share a longer gram on the left and half on the right. That goes on, as long as a gram is
crowded, up to whole windows, which cannot differ; suffixes are sorted and intervals scanned in
every part. How far it goes depends on the counts of the whole corpus, not on its layout.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.llm import bytetext as bt

GRAM = 24
#: Text bytes of a block: a task holds some 60 times as much while it looks for anchors.
BLOCK_BYTES = 2 << 20
MIN_BLOCKS = 16
ROW_BYTES = 64
#: Text bytes for each bucket of anchors, and for each bucket of pieces.
ANCHOR_BUCKET_BYTES = 32 << 20
PIECE_BUCKET_BYTES = 6 << 20
MIN_BUCKETS = 16
#: Rows that are filled at once, which bounds the memory for positions.
MATRIX_ROWS = 8192
#: Different pieces of one gram beyond which it is split into two longer ones.
CROWD = 2000
_TAG = np.uint64(0xFFFFFFFF)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Block:
    """The texts of a block in a fixed order, and the pieces around their anchors."""

    def __init__(self, table: pa.Table, least: int):
        bt.release()
        table = table.sort_by([("doc_id", "ascending"), ("_text_key", "ascending")])
        column = table["text"]
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        self.table = table
        self.least = least
        self.buffer, self.offsets = bt.text_buffer(column)
        ids = table["doc_id"]
        self.named = ids.is_valid().to_numpy(zero_copy_only=False).astype(bool)
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)

    def find(self) -> None:
        """Runs of windows of one anchor: (start, number of windows, document, anchor hash) of each."""
        empty = np.zeros(0, np.int64)
        self.starts, self.windows, self.owners, self.anchors = empty, empty, empty, empty.astype(np.uint64)
        self.places = empty
        n, least, gram = len(self.buffer), self.least, min(GRAM, self.least)
        counts = np.maximum(np.diff(self.offsets) - least + 1, 0) * self.named
        if not counts.any():
            return
        self.sums = bt.prefix_hashes(self.buffer)
        grams = (self.sums[gram:] - self.sums[:-gram]) * bt.powers(n + 1 - gram, inverse=True)
        grams = bt.mix(grams)
        places = np.arange(len(grams), dtype=np.uint64)
        lowest = sliding_minimum((grams & ~_TAG) | places, least - gram + 1)
        window = bt.expand(self.offsets[:-1], counts)
        anchor = (lowest[window] & _TAG).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        first = np.flatnonzero(new)
        self.starts = window[first]
        self.windows = np.diff(np.append(first, len(window)))
        self.owners = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.places = anchor[first]
        self.anchors = grams[self.places]

    def node(self, runs: np.ndarray, low: int, high: int):
        """Of runs of windows those with a window that begins ``low`` to ``high`` - 1 bytes before its anchor.

        (which runs, first windows, numbers of windows, hashes of what all such windows share)
        """
        first = self.places[runs] - self.starts[runs]
        begin, end = np.minimum(first, high - 1), np.maximum(first - self.windows[runs] + 1, low)
        inside = np.flatnonzero(begin >= end)
        place = self.places[runs[inside]]
        grams = bt.range_hashes(self.sums, place - low, place - high + 1 + self.least)
        keys = bt.mix(grams ^ np.uint64((low << 32) + high))
        return runs[inside], place - begin[inside], begin[inside] - end[inside] + 1, keys

    def anchor_table(self):
        """(distinct anchors, number of each run's anchor, in how many documents, with how many pieces)."""
        values, _, codes = bt.distinct(self.anchors)
        documents = _distinct_pairs(codes, self.owners, len(values))
        bodies = bt.range_hashes(self.sums, self.starts, self.starts + self.windows + self.least - 1)
        return values, codes, documents, _distinct_pairs(codes, bodies, len(values))


def _distinct_pairs(codes: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many distinct values each code has."""
    keys = bt.mix(codes.astype(np.uint64)) ^ bt.mix(values.astype(np.uint64) + np.uint64(0x51ED270B))
    _, sample, _ = bt.distinct(bt.mix(keys))
    return np.bincount(codes[sample], minlength=n)


def body_matrix(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Bytes of each range in a row, padded with zeros."""
    matrix = np.zeros((len(starts), width), np.uint8)
    for at in range(0, len(starts), MATRIX_ROWS):
        some = slice(at, at + MATRIX_ROWS)
        matrix[some][np.arange(width) < lengths[some, None]] = buffer[bt.expand(starts[some], lengths[some])]
    return matrix


def exact_groups(hashes: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, group of each row) of rows with equal bytes: hashes, then the bytes themselves."""
    _, sample, codes = bt.distinct(hashes)
    if len(sample):
        same = lengths == lengths[sample][codes]
        for at in range(0, len(matrix), MATRIX_ROWS):
            some = slice(at, at + MATRIX_ROWS)
            same[some] &= (matrix[some] == matrix[sample[codes[some]]]).all(1)
        if not same.all():
            odd = np.flatnonzero(~same)
            codes = codes.copy()
            codes[odd] = len(sample) + np.arange(len(odd))
            sample = np.concatenate([sample, odd])
    return sample, codes


def suffix_order(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows in the order of their bytes; a row that begins another comes first."""
    width = -(-matrix.shape[1] // 8) * 8
    padded = np.zeros((len(matrix), width), np.uint8)
    padded[:, : matrix.shape[1]] = matrix
    columns = padded.view(">u8").astype(np.uint64)
    return np.lexsort([lengths, *(columns[:, n] for n in range(columns.shape[1] - 1, -1, -1))])


def common_prefixes(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before; 0 for the first."""
    result = np.zeros(len(matrix), np.int64)
    if len(matrix) > 1:
        differ = matrix[1:] != matrix[:-1]
        shared = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
        result[1:] = np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))
    return result


#: What stands to the left of a suffix: a byte, or one of these.
EDGE, DIVERSE = 256, 257


def intervals(prefixes: list[int], lefts: list[int], least: int) -> list[tuple[int, int, int]]:
    """(first row, last row, length) of the left-diverse common-prefix intervals of at least ``least`` bytes.

    One pass over the common-prefix lengths with a stack of open intervals. Each keeps the byte to the
    left of all its members, or that they differ; a closed interval hands that on to its parent.
    """
    found = []
    stack: list[list[int]] = []
    n = len(prefixes)
    for row in range(1, n + 1):
        length = prefixes[row] if row < n else 0
        begin, left = row - 1, lefts[row - 1]
        if stack:
            top = stack[-1]
            if top[2] != left or left == EDGE:
                top[2] = DIVERSE
        while stack and stack[-1][0] > length:
            shared, begin, left = stack.pop()
            if left == DIVERSE:
                found.append((begin, row - 1, shared))
            if stack and (stack[-1][2] != left or left == EDGE):
                stack[-1][2] = DIVERSE
        if length >= least and (not stack or stack[-1][0] < length):
            if begin == row - 1:
                left = lefts[begin]
                left = DIVERSE if left == EDGE else left
            stack.append([length, begin, left])
    return found


def halves(low: int, high: int) -> list[tuple[int, int]]:
    """The two parts of a range of windows; none of a single one."""
    middle = (low + high) // 2
    return [(low, middle), (middle, high)] if high - low > 1 else []


def _by_bucket(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket, edges of the buckets in it)."""
    bucket = (values % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


class Deal:
    """What a block deals to buckets, from the marks of its anchors and grams: the same in every pass over it."""

    def __init__(self, block: Block, marks: dict[int, list[tuple[int, bytes]]], anchor_buckets: int):
        block.find()
        self.block = block
        self.buckets = anchor_buckets
        values, _, codes = bt.distinct(block.anchors)
        state = self.read(values, marks.get(0, []))[codes]
        self.whole, self.crowded = np.flatnonzero(state == 1), np.flatnonzero(state == 2)
        self.marks = marks

    def read(self, values: np.ndarray, rows: list[tuple[int, bytes]]) -> np.ndarray:
        """The marks of sorted different keys, as the buckets have sent them."""
        marks = np.zeros(len(values), np.uint8)
        order, edges = _by_bucket(values, self.buckets)
        for bucket, packed in rows:
            marks[order[edges[bucket] : edges[bucket + 1]]] = _unpacked(packed, np.uint8)
        return marks

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, hashes of the pieces) of all grams that a crowded anchor may be split into, whole windows left out."""
        keys, bodies = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        todo = halves(0, self.block.least - min(GRAM, self.block.least) + 1)
        while todo and len(self.crowded):
            low, high = todo.pop()
            if high - low > 1:
                _, starts, windows, grams = self.block.node(self.crowded, low, high)
                keys.append(grams)
                bodies.append(bt.range_hashes(self.block.sums, starts, starts + windows + self.block.least - 1))
                todo += halves(low, high)
        return np.concatenate(keys), np.concatenate(bodies)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, owners, keys) of all pieces: those of anchors, and parts of those of crowded ones."""
        block = self.block
        found = [(block.starts[self.whole], block.windows[self.whole], block.owners[self.whole], block.anchors[self.whole])]
        if len(self.crowded):
            keys, _, _ = bt.distinct(self.nodes()[0])
            marks = self.read(keys, self.marks.get(1, []))
            todo = [(self.crowded, *x) for x in halves(0, block.least - min(GRAM, block.least) + 1)]
            while todo:
                runs, low, high = todo.pop()
                runs, starts, windows, grams = block.node(runs, low, high)
                split = np.zeros(len(runs), bool)
                if high - low > 1 and len(runs):
                    split = marks[np.searchsorted(keys, grams)] == 2
                    todo += [(runs[split], *x) for x in halves(low, high)]
                found.append((starts[~split], windows[~split], block.owners[runs[~split]], grams[~split]))
        starts, windows, owners, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        return starts, windows + block.least - 1, owners, keys

    def dealt(self, buckets: int):
        """(starts and owners of all places, places by distinct piece, their edges, rows of each bucket's distinct pieces)."""
        starts, lengths, owners, keys = self.pieces()
        block = self.block
        if not len(starts):
            return None
        matrix = body_matrix(block.buffer, starts, lengths, int(lengths.max()))
        hashes = bt.range_hashes(block.sums, starts, starts + lengths)
        sample, group = exact_groups(bt.mix(hashes ^ keys), matrix, lengths)
        by_group = np.argsort(group, kind="stable")
        group_edges = np.searchsorted(group[by_group], np.arange(len(sample) + 1))
        order, edges = _by_bucket(bt.mix(keys[sample]), buckets)
        return starts, lengths, owners, sample, by_group, group_edges, order, edges


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Values as compressed bytes, their number first."""
    raw = np.ascontiguousarray(values, kind).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(
        pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True), kind
    )


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    parts = [_unpacked(p, kind) for p in table[name].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _counts(table: pa.Table, name: str, width: int) -> list[int]:
    """How many values of ``width`` bytes each row has."""
    return [int.from_bytes(p[:4], "little") // width for p in table[name].to_pylist()]


def bucket_repeats(table: pa.Table, least: int) -> dict[str, list]:
    """The maximal repeats among a bucket's pieces: for each block, what to report of each of its pieces, in columns."""
    table = table.sort_by("block")
    lengths = _joined(table, "lengths", np.uint16).astype(np.int64)
    bodies = _joined(table, "bodies", np.uint8)
    times = _joined(table, "times", np.uint8).astype(np.int64)
    firsts = _joined(table, "firsts", np.int64)
    counts = _counts(table, "times", 1)

    starts = np.cumsum(lengths) - lengths
    sums = bt.prefix_hashes(bodies)
    width = int(lengths.max())
    matrix = body_matrix(bodies, starts, lengths, width)
    sample, codes = exact_groups(bt.range_hashes(sums, starts, starts + lengths), matrix, lengths)
    first_id = np.full(len(sample), np.iinfo(np.int64).max)
    np.minimum.at(first_id, codes, firsts)
    n_places = np.bincount(codes, times)

    # Suffixes that share their first bytes with another distinct piece's.
    windows = lengths[sample] - least + 1
    owner = np.repeat(np.arange(len(sample)), windows)
    offset = bt.expand(np.zeros(len(sample), np.int64), windows)
    at = starts[sample][owner] + offset
    _, _, same = bt.distinct(bt.range_hashes(sums, at, at + least))
    shared = np.bincount(same)[same] > 1
    owner, offset, at = owner[shared], offset[shared], at[shared]
    # A piece with several places is a repeat by itself: the common prefix of equal suffixes is all of it.
    alone = np.flatnonzero(n_places > 1)
    leafs, sizes_of, offsets = [alone], [lengths[sample][alone]], [np.zeros(len(alone), np.int64)]
    numbers, lowest_of = [np.arange(len(alone))], [first_id[alone]]
    if len(owner):
        size = lengths[sample][owner] - offset
        suffixes = body_matrix(bodies, at, size, width)
        order = suffix_order(suffixes, size)
        suffixes, size = suffixes[order], size[order]
        owner, offset, at = owner[order], offset[order], at[order]
        prefixes = common_prefixes(suffixes, size)
        lefts = np.where(offset > 0, bodies[at - 1].astype(np.int64), EDGE)
        found = np.array(intervals(prefixes.tolist(), lefts.tolist(), least), np.int64).reshape(-1, 3)
        if len(found):
            sizes = found[:, 1] - found[:, 0] + 1
            member = bt.expand(found[:, 0], sizes)
            lowest = np.minimum.reduceat(first_id[owner[member]], np.cumsum(sizes) - sizes)
            leafs.append(owner[member])
            sizes_of.append(np.repeat(found[:, 2], sizes))
            offsets.append(offset[member])
            numbers.append(np.repeat(len(alone) + np.arange(len(found)), sizes))
            lowest_of.append(np.repeat(lowest, sizes))
    leaf, length, offset, number, lowest = (np.concatenate(x) for x in (leafs, sizes_of, offsets, numbers, lowest_of))
    by_leaf = np.argsort(leaf, kind="stable")
    leaf_edges = np.searchsorted(leaf[by_leaf], np.arange(len(sample) + 1))
    rows = {name: [] for name in ("block", "bucket", "reports", *(c for c, _ in _FIELDS))}
    ends = np.cumsum(counts).tolist()
    for row, (begin, end) in enumerate(zip([0, *ends], ends, strict=False)):
        reported = np.diff(leaf_edges)[codes[begin:end]]
        chosen = by_leaf[bt.expand(leaf_edges[codes[begin:end]], reported)]
        if not len(chosen):
            continue
        rows["block"].append(table["block"][row].as_py())
        rows["bucket"].append(table["bucket"][row].as_py())
        rows["reports"].append(_packed(reported, np.int32))
        rows["offsets"].append(_packed(offset[chosen], np.uint16))
        rows["lengths"].append(_packed(length[chosen], np.uint16))
        rows["repeats"].append(_packed(number[chosen], np.int32))
        rows["firsts"].append(_packed(lowest[chosen], np.int64))
    return rows


def _in_blocks(docs: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...], block_bytes: int):
    """(texts by block, their size in bytes, a row counting for some itself). Equal rows are in one block."""
    size = docs.select(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    blocks = max(MIN_BLOCKS, -(-size // block_bytes))
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    key = F.xxhash64(docs[id_column], text)
    texts = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        text.alias("text"),
        key.alias("_text_key"),
        F.pmod(key, F.lit(blocks)).alias("block"),
        *(docs[c].alias(f"_keep{n}") for n, c in enumerate(keep)),
    )
    return texts, size


def _again(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can meet what was made from it."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


_MARKS = pa.schema([("level", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])
_TAGS = pa.schema([*_MARKS, ("tags", pa.binary()), ("times", pa.binary()), ("pieces", pa.binary())])
_FIELDS = (("offsets", np.uint16), ("lengths", np.uint16), ("repeats", np.int32), ("firsts", np.int64))
_REPORTS = pa.schema([*_MARKS, *((c, pa.binary()) for c in ("reports", *(c for c, _ in _FIELDS)))])
_PIECES = pa.schema([*_MARKS, *((c, pa.binary()) for c in ("lengths", "bodies", "times", "firsts"))])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _rows(schema: pa.Schema, marks: pa.Table, **columns: list) -> pa.Table:
    """Rows of ``schema`` from some of its columns, and the marks, which travel along to the next stage."""
    n = len(next(iter(columns.values())))
    made = pa.table([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)
    kept = marks.filter(pc.is_valid(marks["marks"])).select(_MARKS.names)
    for field in list(schema)[len(_MARKS) :]:
        kept = kept.append_column(field, pa.nulls(len(kept), field.type))
    return pa.concat_tables([made, kept.select(schema.names).cast(schema)])


def repeat_reports(texts: DataFrame, size: int, least: int, within: bool, make, schema) -> DataFrame:
    """``make(block, reports)`` of every block, where reports are those of its pieces, at all their places.

    They come bucket by bucket: (owners, starts in the block, lengths, repeats, smallest ids, bucket).
    Unless ``within``, anchors that a single document has are left out. Marks tell a block which
    of its anchors (level 0) and of the longer grams of crowded ones (level 1) are dealt whole (1) or split (2).
    """
    anchor_buckets = max(MIN_BUCKETS, -(-size // ANCHOR_BUCKET_BYTES))
    piece_buckets = max(MIN_BUCKETS, -(-size // PIECE_BUCKET_BYTES))

    def tagged(block: int, level: int, marks: pa.Table, values, times, pieces) -> pa.Table:
        order, edges = _by_bucket(values, anchor_buckets)
        used = np.flatnonzero(np.diff(edges)).tolist()
        chosen = [order[edges[bucket] : edges[bucket + 1]] for bucket in used]
        return _rows(
            _TAGS,
            marks,
            level=[level] * len(used),
            block=[block] * len(used),
            bucket=used,
            tags=[_packed(values[x] >> np.uint64(32), np.uint32) for x in chosen],
            times=[_packed(np.minimum(times[x], 2), np.uint8) for x in chosen],
            pieces=[_packed(pieces[x], np.uint32) for x in chosen],
        )

    def anchors(table: pa.Table) -> pa.Table:
        block, none = Block(table, least), np.zeros(0, np.uint64)
        block.find()
        marks = _MARKS.empty_table()
        if not len(block.starts):
            return tagged(0, 0, marks, none, none, none)
        values, codes, documents, pieces = block.anchor_table()
        times = np.bincount(codes, minlength=len(values)) if within else documents
        return tagged(table["block"][0].as_py(), 0, marks, values, times, pieces)

    def grams(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        marks = _marks(right)
        if not len(left) or not any((_unpacked(m, np.uint8) == 2).any() for _, m in marks.get(0, [])):
            return tagged(0, 1, right, none, none, none)
        keys, bodies = Deal(Block(left, least), marks, anchor_buckets).nodes()
        values, _, codes = bt.distinct(keys)
        pieces = _distinct_pairs(codes, bodies, len(values))
        return tagged(left["block"][0].as_py(), 1, right, values, np.full(len(values), 2), pieces)

    def marked(table: pa.Table) -> pa.Table:
        found = [table.filter(pc.is_valid(table["marks"])).select(_MARKS.names)]
        for level in (0, 1):
            some = table.filter(pc.and_(pc.is_valid(table["tags"]), pc.equal(table["level"], level)))
            if not len(some):
                continue
            _, _, codes = bt.distinct(_joined(some, "tags", np.uint32).astype(np.uint64))
            times = np.bincount(codes, _joined(some, "times", np.uint8))[codes]
            pieces = np.bincount(codes, _joined(some, "pieces", np.uint32))[codes]
            state = (times > 1).astype(np.uint8) + (times > 1) * (pieces > CROWD).astype(np.uint8)
            edges = np.concatenate([[0], np.cumsum(_counts(some, "tags", 4))]).tolist()
            packed = [_packed(state[a:b], np.uint8) for a, b in zip(edges, edges[1:], strict=False)]
            made = [some["level"], some["block"], some["bucket"], pa.array(packed, pa.binary())]
            found.append(pa.table(made, schema=_MARKS))
        return pa.concat_tables([x.cast(_MARKS) for x in found])

    def pieces(left: pa.Table, right: pa.Table) -> pa.Table:
        used, parts, dealt = [], [], None
        if len(left) and len(right):
            block = Block(left, least)
            dealt = Deal(block, _marks(right), anchor_buckets).dealt(piece_buckets)
        if dealt is not None:
            starts, lengths, owners, sample, by_group, group_edges, order, edges = dealt
            first = np.minimum.reduceat(block.ids[owners[by_group]], group_edges[:-1])
            times = np.minimum(np.diff(group_edges), 2)
            used = np.flatnonzero(np.diff(edges)).tolist()
            parts = [order[edges[bucket] : edges[bucket + 1]] for bucket in used]
        return _rows(
            _PIECES,
            right,
            block=[left["block"][0].as_py()] * len(used) if used else [],
            bucket=used,
            lengths=[_packed(lengths[sample[x]], np.uint16) for x in parts],
            bodies=[
                _packed(block.buffer[bt.expand(starts[sample[x]], lengths[sample[x]])], np.uint8) for x in parts
            ],
            times=[_packed(times[x], np.uint8) for x in parts],
            firsts=[_packed(first[x], np.int64) for x in parts],
        )

    def reported(table: pa.Table) -> pa.Table:
        some = table.filter(pc.is_valid(table["bodies"]))
        columns = bucket_repeats(some, least) if len(some) else {"block": []}
        return _rows(_REPORTS, table, **columns)

    def places(block: Block, table: pa.Table):
        rows = [r for r in table.to_pylist() if r["reports"] is not None]
        dealt = Deal(block, _marks(table), anchor_buckets).dealt(piece_buckets) if rows else None
        for row in rows:
            starts, _, owners, _, by_group, group_edges, order, edges = dealt
            chosen = order[edges[row["bucket"]] : edges[row["bucket"] + 1]]
            piece = np.repeat(chosen, _unpacked(row["reports"], np.int32).astype(np.int64))
            each = np.diff(group_edges)[piece]
            place = by_group[bt.expand(group_edges[piece], each)]
            fields = [np.repeat(_unpacked(row[c], kind).astype(np.int64), each) for c, kind in _FIELDS]
            yield owners[place], starts[place] + fields[0], *fields[1:], row["bucket"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, least)
        return make(block, places(block, right))

    def blocks():
        return _again(texts).groupBy("block")

    # The texts are shuffled once: every stage meets them in their blocks again.
    counted = blocks().applyInArrow(anchors, _ddl(_TAGS)).groupBy("bucket").applyInArrow(marked, _ddl(_MARKS))
    split = blocks().cogroup(counted.groupBy("block")).applyInArrow(grams, _ddl(_TAGS))
    marks = split.groupBy("bucket").applyInArrow(marked, _ddl(_MARKS))
    dealt = blocks().cogroup(marks.groupBy("block")).applyInArrow(pieces, _ddl(_PIECES))
    found = dealt.groupBy("bucket").applyInArrow(reported, _ddl(_REPORTS))
    return blocks().cogroup(found.groupBy("block")).applyInArrow(run, schema)


def _marks(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    """(bucket, marks) of each level."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    columns = (table[c].to_pylist() for c in ("level", "bucket", "marks"))
    for level, bucket, marks in zip(*columns, strict=True):
        if marks is not None:
            found.setdefault(level, []).append((bucket, marks))
    return found


def maximal_repeats(
    docs: DataFrame, least: int = 50, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(repeat, doc_id, start, length): every place of every maximal repeat of ``least`` bytes or more.

    Rows of one ``repeat`` hold the same bytes. Texts are UTF-8 bytes; repeats do not cross documents.
    Null and short texts and rows with a null id hold none. Places in one document count like those in
    two. A repeat longer than a piece comes as overlapping repeats.
    """
    texts, size = _in_blocks(docs, id_column, text_column, (), block_bytes)

    def name(block: Block, reports) -> pa.Table:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for owners, starts, lengths, repeats, _, bucket in reports:
            found = ((bucket << 32) + repeats, block.ids[owners], starts - block.offsets[owners], lengths)
            for column, values in zip(columns, found, strict=True):
                column.append(values)
        made = [pa.array(np.concatenate(c)) for c in columns]
        return pa.table(made, names=["repeat", "doc_id", "start", "length"])

    ddl = "repeat long, doc_id long, start long, length long"
    return repeat_reports(texts, size, least, True, name, ddl)


def remove_repeats(
    docs: DataFrame,
    least: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    with_text: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, *keep, n_bytes, n_removed, n_spans, kept_sha256[, kept_text]), a row for each row of ``docs``.

    A byte goes if it lies in a string of ``least`` bytes that also starts in a document with a smaller
    id, judged on the input texts. ``kept_text`` is what is left; bytes of characters that lost a part
    are dropped from it. Null texts are empty; rows with a null id neither lose nor cause a loss; rows
    of one id aren't compared with each other; an empty table gives an empty result.
    """
    texts, size = _in_blocks(docs, id_column, text_column, keep, block_bytes)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            *(T.StructField(c, docs.schema[c].dataType) for c in keep),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            *([T.StructField("kept_text", T.StringType())] if with_text else []),
        ]
    )
    names = schema.fieldNames()

    def remove(block: Block, reports) -> pa.Table:
        n, offsets = len(block.buffer), block.offsets
        change = np.zeros(n + 1, np.int64)
        for owners, starts, lengths, _, firsts, _ in reports:
            later = block.ids[owners] > firsts
            np.add.at(change, starts[later], 1)
            np.add.at(change, (starts + lengths)[later], -1)
        gone = np.cumsum(change[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        opens[heads] = gone[heads]
        removed, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, opens))
        kept_offsets = offsets - removed
        kept = block.buffer[~gone].tobytes()
        parts = [kept[a:b] for a, b in zip(kept_offsets[:-1].tolist(), kept_offsets[1:].tolist(), strict=True)]
        columns = [
            block.table["doc_id"],
            *(block.table[f"_keep{i}"] for i in range(len(keep))),
            pa.array(np.diff(offsets)),
            pa.array(np.diff(removed)),
            pa.array(np.diff(spans)),
            pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
        ]
        if with_text:
            columns.append(pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string()))
        return pa.table(columns, names=names)

    return repeat_reports(texts, size, least, False, remove, schema)
