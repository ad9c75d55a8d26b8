"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, found by pointer jumping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import byte_texts, pieces
from gridloom.session import settle

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: About so many bytes of text share one list of distinct links.
CHUNK_BYTES = 16 << 20
#: A space after something else than a space and before something that is no white space: no token of either kind spans it.
CUT = re.compile(r" (?<=[^ ] )(?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest, in order, for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class TokenizerPair:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, byte_level: bytes, piece_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_level.decode()), sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = [alphabet.get(c) for c in entry]
            self.a_bytes[i] = b"" if None in known else bytes(known)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            own = b"" if self.b.is_control(i) else bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()
            self.b_bytes.append(own)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        #: Texts may be cut at CUT if no piece holds a space behind another character and white space is split off by A's pattern.
        spans = any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(self.b.get_piece_size()))
        self.cuttable = not spans and type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None

    def segments(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuttable else [text]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch([" " + s for s in segments], add_special_tokens=False) if segments else []
        return [x.ids for x in a], self.b.encode(segments, num_threads=1) if segments else []


class TokenizerFiles:
    """Contents of both vocabulary files, a few MB of fixed size: read by the driver, broadcast, and built once a process."""

    def __init__(self, folder: str = FOLDER):
        self.contents, self.built = [], None
        for name in (BYTE_LEVEL, PIECES):
            with open(f"{folder}/{name}", "rb") as f:
                self.contents.append(f.read())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def pair(self) -> TokenizerPair:
        if self.built is None:
            self.built = TokenizerPair(*self.contents)
        return self.built


def terminal_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For every token of A, then of B: the last token of its component, by pointer jumping.

    Each token points to the farthest-right token of the other side that it overlaps, or to itself where it is the farthest;
    of two that end together B's is the one. Successors are doubled until nothing moves.
    """
    n = len(a_ends)
    after_a = n + np.searchsorted(b_ends, a_ends, "left")
    cover = np.searchsorted(a_ends, b_ends, "left")
    after_b = np.where(a_ends[cover] == b_ends, n + np.arange(len(b_ends)), cover) if len(b_ends) else np.zeros(0, np.int64)
    succ = np.concatenate([after_a, after_b])
    while True:
        farther = succ[succ]
        if (farther == succ).all():
            return succ
        succ = farther


@dataclass
class Aligned:
    """Aligned segments, flat: token ids of both sides, group number of every token, links, and where each segment begins."""

    a: np.ndarray
    b: np.ndarray
    a_start: np.ndarray
    b_start: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_start: np.ndarray
    group_end: np.ndarray  # byte offset behind each group, over all segments
    link_a: np.ndarray  # places in a
    link_b: np.ndarray
    link_start: np.ndarray
    whole: np.ndarray  # segments whose bytes both tokenizers give back


def _starts(lengths: Iterable[int], n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64, n))])


def align_segments(pair: TokenizerPair, segments: list[str]) -> Aligned:
    a_ids, b_ids = pair.encode(segments)
    whole = np.zeros(len(segments), bool)
    for i, s in enumerate(segments):
        raw = b" " + s.encode("utf-8", "surrogatepass")
        whole[i] = b"".join([pair.a_bytes[t] for t in a_ids[i]]) == raw == b"".join([pair.b_bytes[t] for t in b_ids[i]])
        if not whole[i]:
            a_ids[i], b_ids[i] = [], []
    n = len(segments)
    a_start, b_start = _starts(map(len, a_ids), n), _starts(map(len, b_ids), n)
    a, b = np.fromiter(chain.from_iterable(a_ids), np.int64, a_start[-1]), np.fromiter(chain.from_iterable(b_ids), np.int64, b_start[-1])
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    last = terminal_tokens(a_ends, b_ends)
    ends = last[len(a) :] == len(a) + np.arange(len(b))  # tokens of B that end a group
    number = np.cumsum(ends) - 1
    group = number[last - len(a)] if len(last) else last
    marks = np.concatenate([[0], np.cumsum(ends)])
    cuts = np.union1d(a_ends, b_ends)  # each stretch between two cuts is the overlap of one token of A with one of B
    link_a, link_b = np.searchsorted(a_ends, cuts, "left"), np.searchsorted(b_ends, cuts, "left")
    return Aligned(a, b, a_start, b_start, group[: len(a)], group[len(a) :], marks[b_start], b_ends[ends], link_a, link_b, np.searchsorted(link_a, a_start, "left"), whole)


class Spelling:
    """Decimal ids with the sign that follows them, for writing groups."""

    def __init__(self, size: int):
        self.size, self.table = size, [b"%d%c" % (i, sign) for sign in b",|;" for i in range(size)]

    def written(self, got: Aligned) -> list[bytes]:
        """Each segment's groups as ``a1,a2|b1;``, every group closed by a semicolon."""
        n_groups = len(got.group_end)
        a_of, b_of = np.bincount(got.a_group, minlength=n_groups), np.bincount(got.b_group, minlength=n_groups)
        a_behind, b_before = np.cumsum(a_of), np.cumsum(b_of) - b_of
        at_a, at_b = np.arange(len(got.a)) + b_before[got.a_group], np.arange(len(got.b)) + a_behind[got.b_group]
        codes = np.empty(len(got.a) + len(got.b), np.int64)
        codes[at_a], codes[at_b] = got.a, got.b
        codes[a_behind - 1 + b_before] += self.size
        codes[np.cumsum(a_of + b_of) - 1] += 2 * self.size
        words, starts = [self.table[c] for c in codes.tolist()], (got.a_start + got.b_start).tolist()
        return [b"".join(words[s:e]) for s, e in zip(starts, starts[1:])]


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs ``which`` and all places in them, run after run."""
    sizes = starts[which + 1] - starts[which]
    return sizes, np.repeat(starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Facts:
    """One text: counts, digest and its distinct links with how often each occurs."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    digest: str = ""
    links: np.ndarray | None = None
    times: np.ndarray | None = None


def align_batch(pair: TokenizerPair, spelling: Spelling, texts: list[bytes | None]) -> list[Facts]:
    """Each distinct segment of the batch is tokenized and aligned once; texts are put together from segments."""
    known: dict[str, int] = {}
    parts = [np.fromiter((known.setdefault(s, len(known)) for s in pair.segments(t.decode("utf-8", "surrogatepass"))) if t else [], np.int64) for t in texts]
    got = align_segments(pair, list(known))
    written, codes = spelling.written(got), got.a[got.link_a] * len(pair.b_bytes) + got.b[got.link_b]
    a_of, b_of, groups = np.diff(got.a_start), np.diff(got.b_start), np.diff(got.group_start)
    out = [Facts() for _ in texts]
    fine = [i for i, p in enumerate(parts) if len(p) and got.whole[p].all()]
    if not fine:
        return out
    owner = np.repeat(fine, [len(parts[i]) for i in fine])
    sizes, places = _spread(got.link_start, np.concatenate([parts[i] for i in fine]))
    pairs, times = np.unique((np.repeat(owner, sizes) << 40) | codes[places], return_counts=True)
    cuts = np.searchsorted(pairs >> 40, np.arange(len(texts) + 1))
    for i in fine:
        p, s = parts[i], slice(cuts[i], cuts[i + 1])
        digest = hashlib.sha256(b"".join([written[k] for k in p.tolist()])[:-1]).hexdigest()
        out[i] = Facts(int(a_of[p].sum()), int(b_of[p].sum()), int(groups[p].sum()), int(times[s].sum()), digest, pairs[s] & ((1 << 40) - 1), times[s])
    return out


def _packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (places, times)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 4, n)
    return tuple(np.ascontiguousarray(x.T).view("<u4").reshape(-1).astype(np.int64) for x in raw)


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    named = [T.StructField("doc_id", T.ArrayType(id_type)), *[T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups", "n_links", "n_distinct")], T.StructField("groups_sha256", T.ArrayType(T.StringType()))]
    return T.StructType([*named, T.StructField("links", T.BinaryType()), T.StructField("pair", longs), T.StructField("docs", longs)])


def aligned_chunks(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Tokenized and aligned texts, one row for about CHUNK_BYTES of neighbouring texts (a longer text is a row alone).

    A row holds the facts of its documents, the distinct links of the chunk (``pair`` = A id * size of B + B id, ``docs`` = its
    documents that hold it) and, packed, each document's places in that list.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(TokenizerFiles(folder))
    schema = _chunk_schema(docs.schema["doc_id"].dataType)

    def row(ids: list[pa.Array], facts: list[Facts], arrow: pa.Schema) -> pa.RecordBatch:
        empty = np.zeros(0, np.int64)
        links = [f.links if f.links is not None else empty for f in facts]
        pair, docs_with = np.unique(np.concatenate(links), return_counts=True)
        n_distinct = [len(x) for x in links]
        places = np.searchsorted(pair, np.concatenate(links))
        firsts = np.concatenate([[0], np.cumsum(n_distinct)])[:-1]
        steps = np.diff(places, prepend=0)
        live = firsts[np.array(n_distinct) > 0]
        steps[live] = places[live]  # the first place of a document counts from 0
        times = np.concatenate([f.times if f.times is not None else empty for f in facts])
        values = [pa.concat_arrays(ids), *[pa.array([getattr(f, c) for f in facts], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(n_distinct, pa.int64()), pa.array([f.digest for f in facts])]
        lists = [pa.ListArray.from_arrays([0, len(v)], v) for v in values]
        tail = [pa.array([_packed(steps, times)], pa.binary()), *[pa.ListArray.from_arrays([0, len(v)], pa.array(v, pa.int64())) for v in (pair, docs_with)]]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*lists, *tail], arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tokenizers = files.value.pair()
        spelling, arrow = Spelling(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes))), to_arrow_schema(schema)
        ids, facts, held = [], [], 0
        for piece in pieces(batches, "text"):
            texts = byte_texts(piece.column("text"))
            ids.append(piece.column("doc_id"))
            facts += align_batch(tokenizers, spelling, texts)
            held += sum(len(t) for t in texts if t)
            if held >= CHUNK_BYTES:
                yield row(ids, facts, arrow)
                ids, facts, held = [], [], 0
        if facts:
            yield row(ids, facts, arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def link_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, held, best): documents of the corpus that hold the pair linked, and whether none of its A id's pairs has more."""
    pairs = chunks.select(F.inline(F.arrays_zip("pair", "docs"))).groupBy("pair").agg(F.sum("docs").alias("held"))
    pairs = pairs.select("pair", F.expr(f"pair div {b_size}").alias("a"), (F.col("pair") % b_size).alias("b"), "held")
    tops = pairs.groupBy("a").agg(F.max("held").alias("top"))
    return pairs.join(tops, "a").select("pair", "a", "b", "held", (F.col("held") == F.col("top")).alias("best"))


def alignment_report(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Query rows: counts, digest of the groups and corpus-wide figures of the links of every document.

    Null and empty texts, and texts whose bytes a tokenizer doesn't give back, have zeros and an empty digest, and count for
    no pair. Repeated rows are separate documents. Equal counts are all best. An empty table gives no rows; other columns of
    the table, whatever their names, are not read. Texts are tokenized once; what a chunk needs of the corpus-wide counts is
    joined by pair and brought back to the chunk, so rows shuffled grow with the distinct pairs of chunks, not with links.
    """
    b_size = len(TokenizerFiles(folder).pair().b_bytes)
    chunks = settle(aligned_chunks(docs, folder).withColumn("chunk", F.monotonically_increasing_id()))
    wanted = chunks.select("chunk", F.posexplode("pair").alias("place", "pair"))
    found = wanted.join(link_counts(chunks, b_size).select("pair", "held", "best"), "pair").select("chunk", "place", "held", "best")
    id_type = docs.schema["doc_id"].dataType
    longs = ("n_a", "n_b", "n_groups", "n_links")
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in (*longs, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def counted(mine: pa.Table, looked: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        held, best = np.zeros(looked.num_rows, np.int64), np.zeros(looked.num_rows, np.int64)
        at = looked["place"].to_numpy()
        held[at], best[at] = looked["held"].to_numpy(), looked["best"].to_numpy(zero_copy_only=False)
        cells = {c: mine[c].combine_chunks().flatten() for c in ("doc_id", *longs, "n_distinct", "groups_sha256")}
        sizes = cells["n_distinct"].to_numpy()
        ends = np.cumsum(sizes)
        steps, times = _unpacked(mine["links"][0].as_py(), int(sizes.sum()))
        firsts = np.concatenate([[0], np.cumsum(steps)])
        places = firsts[1:] - np.repeat(firsts[ends - sizes], sizes)
        summed = [np.concatenate([[0], np.cumsum(times * x[places])]) for x in (best, held)]
        more = [pa.array(x[ends] - x[ends - sizes]) for x in summed]
        return pa.Table.from_arrays([cells["doc_id"], *[cells[c] for c in longs], *more, cells["groups_sha256"]], schema=to_arrow_schema(schema))

    kept = chunks.select(F.col("chunk").alias("of_chunk"), "doc_id", *longs, "n_distinct", "groups_sha256", "links")
    return kept.groupBy("of_chunk").cogroup(found.groupBy("chunk")).applyInArrow(counted, schema)


def aligned_groups(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """The operator's own output: one row a group of each document: doc_id, group (from 0), first and last byte (exclusive) of
    space+text, a_ids and b_ids. Documents without tokens have no rows."""
    files = docs.sparkSession.sparkContext.broadcast(TokenizerFiles(folder))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in ("group", "first", "last")], T.StructField("a_ids", ints), T.StructField("b_ids", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tokenizers, arrow = files.value.pair(), to_arrow_schema(schema)
        for piece in pieces(batches, "text"):
            for k, text in enumerate(byte_texts(piece.column("text"))):
                parts = tokenizers.segments(text.decode("utf-8", "surrogatepass")) if text else []
                got = align_segments(tokenizers, parts)
                n = len(got.group_end)
                if not n or not got.whole.all():
                    continue
                a_ends, b_ends = (np.cumsum(np.bincount(g, minlength=n)) for g in (got.a_group, got.b_group))
                a_ids, b_ids = (pa.ListArray.from_arrays(np.concatenate([[0], e]).astype(np.int32), pa.array(x, pa.int32())) for e, x in ((a_ends, got.a), (b_ends, got.b)))
                first = np.concatenate([[0], got.group_end[:-1]])
                values = [piece.column("doc_id").take(pa.array(np.full(n, k))), pa.array(np.arange(n)), pa.array(first), pa.array(got.group_end), a_ids, b_ids]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(values, arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
