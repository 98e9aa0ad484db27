"""Token ids in Simple-8b files: encode texts, write, read back.

Texts are encoded with the tokenizers library, an end id is appended to each,
and documents are written in ascending id order.

Simple-8b: a 64-bit word holds a 4-bit selector and as many ids as fit in the
other 60 bits at the width the selector names (see ``WIDTHS``).  Packing is
greedy and works per block of ``BLOCK`` ids; a word never crosses a block, and
every block's first word is listed, so blocks decode independently and each
selector's words decode as one array operation.  An id of 2**60 or more is an
escape: its word holds a place in the list of whole 64-bit ids.

A part ends with a trailer in ASCII: "S8B-PART", its number and its ids, 16
digits each.  A file is a sequence of records, each with whole documents and about
``RECORD_IDS`` ids (a longer document makes a longer record).  A record is, in
little-endian 64-bit words: magic, part, ids before it in its part, documents,
ids, blocks, words, escapes; then the document ids, a word per document that is
1 if its id is null, the token counts, the first word of every block, the words
and the escaped ids.  ``SEPARATOR``, one word, follows each record.  Files are
written by Spark's text writer, so they go to any file system and survive lost
executors; parts are ranges of the id, in order.

Defined cases: null text is empty, so it has the end id only; repeated ids stay
next to each other, ordered by the text's hash; null ids come first; an empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotvalue.llm.common import small_batches, stored

# Ids per word and bits per id of selectors 1 to 14.
COUNTS = [0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
ESCAPE = 0
BLOCK = 1024
RECORD_IDS = 1 << 17
RECORDS = 128
END_ID = 2
MAGIC = int.from_bytes(b"S8BTOKEN", "little")
TRAILER = int.from_bytes(b"S8B-PART", "little")
SEPARATOR = "S8B-END\n"
CACHE = 300_000
BATCH_BYTES = 4 << 20  # of text encoded together
_HEAD = 8
_BEFORE_WORD = re.compile(r"(?= \S)")
#: Texts with blanks other than single " " and line ends between words.
_ODD = (r"^[ \n]|[ \n][ \n]|[ \n]$|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
        r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: Marks behind Latin letters at a word's end, a piece of their own.
_MARKS = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-&(-/:-@\[-`{-~]+)( |$)"


def _fitting(ids: np.ndarray) -> np.ndarray:
    """The selector of the word that would start at each id: the one with most
    ids whose widest is narrow enough, looking no further than the block."""
    n = len(ids)
    width = np.zeros((-(-n // BLOCK), BLOCK + COUNTS[1]), np.uint8)  # nothing follows the block's end
    flat = np.zeros(width.shape[0] * BLOCK, np.uint8)
    flat[:n] = np.frexp(ids.astype(np.float64))[1]
    width[:, :BLOCK] = flat.reshape(-1, BLOCK)
    widest, span = width, 1
    choice = np.full(flat.shape, ESCAPE, np.int8).reshape(-1, BLOCK)
    for s in range(len(COUNTS) - 1, 0, -1):
        while span < COUNTS[s]:  # widest of the next ``span`` ids, from two shorter spans
            grow = min(span, COUNTS[s] - span)
            widest = np.maximum(widest[:, :widest.shape[1] - grow], widest[:, grow:])
            span += grow
        choice[widest[:, :BLOCK] <= WIDTHS[s]] = s
    choice = choice.reshape(-1)[:n]
    choice[ids >= np.uint64(1 << 60)] = ESCAPE
    return choice


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of every block, escaped ids) of unsigned ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    choice = _fitting(ids)
    size = np.array([1, *COUNTS[1:]])[choice]
    begins = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):  # all blocks step from word to word together
        begins[at] = True
        at = at + size[at]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    starts = np.flatnonzero(begins)
    if not n:
        return np.empty(0, np.uint64), starts, ids
    selectors = choice[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    escaped = np.flatnonzero(selectors == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    values = ids.copy()
    values[starts[escaped]] = 0
    held = np.diff(np.append(starts, n))
    words |= np.bitwise_or.reduceat(values << _shifts(held, selectors), starts)
    return words, np.searchsorted(starts, np.arange(0, n, BLOCK)), ids[starts[escaped]]


def _shifts(held: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """For each id in turn, its place in its word in bits."""
    first = np.cumsum(held) - held
    place = np.arange(int(held.sum())) - np.repeat(first, held)
    return (place * np.repeat(np.array(WIDTHS)[selectors], held)).astype(np.uint64)


def unpack(words: np.ndarray, firsts: np.ndarray, n: int, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` ids of ``pack``."""
    if not n:
        return np.empty(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = np.array([1, *COUNTS[1:]])[selectors]
    # the last word of a block may hold fewer
    last = np.append(firsts[1:], len(words)) - 1
    upto = np.cumsum(held)
    begin = upto[firsts] - held[firsts]
    held[last] -= upto[last] - begin - np.minimum(BLOCK, n - BLOCK * np.arange(len(firsts)))
    masks = (np.uint64(1) << np.array(WIDTHS, np.uint64)) - np.uint64(1)
    out = (np.repeat(words, held) >> _shifts(held, selectors)) & np.repeat(masks[selectors], held)
    special = np.flatnonzero(selectors == ESCAPE)
    out[(np.cumsum(held) - held)[special]] = escaped[(words[special] & masks[-1]).astype(np.int64)]
    return out


class Words(dict):
    """Ids of ``blank`` and a word, encoded once and kept (the first ``CACHE``
    short ones that a worker meets)."""

    def __init__(self, tokenizer, blank: str):
        self.tokenizer, self.bpe = tokenizer, tokenizer.model
        self.blank, self.blank_unit = blank, blank.translate(_BYTE_ALPHABET)
        self.le = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
        self.marks: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        found = _LATIN.fullmatch(word)
        if not found:
            ids = self.whole(self.blank + word)
        elif found[2]:  # letters and the marks that follow are pieces of their own
            marks = found[2]
            if marks not in self.marks:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[marks] = self.whole(marks)
            ids = self[found[1]] + self.marks[marks]
        else:  # one piece: straight to the model, in the byte alphabet
            le = self.le
            ids = b"".join([le[t.id] for t in self.bpe.tokenize(self.blank_unit + _units(word))])
        if len(self) < CACHE and len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts.  Byte-level BPE (without special strings) splits a text into pieces that never
    reach over a blank right before a word, nor over a line end between two
    words, so words are encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.first, self.later = Words(tokenizer, ""), Words(tokenizer, " ")
        self.line_end = self.first.whole("\n")
        self.raw = Tokenizer(tokenizer.model)  # pieces as they are
        vocab = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        blank = self.later.blank_unit
        self.starts = np.array([token.startswith(blank) for token, _ in vocab])
        # else word by word
        self.rows = [i for _, i in vocab] == list(range(len(vocab))) and not any(
            re.match(f"{blank}?{_LATIN_UNIT}+{blank}", token) for token, _ in vocab)
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.unusual = "|".join([_ODD, *added])

    def odd(self, text: str) -> bytes:
        """Ids of a text with any blanks."""
        first, *rest = _BEFORE_WORD.split(text)
        return b"".join([self.first.whole(first), *[self.later[x[1:]] for x in rest]])

    def word(self, marked: str) -> bytes:
        if marked[:1] == "\r":  # the first of a text
            return self.first[marked[1:]]
        if marked[:1] == "\n":
            return self.line_end + self.first[marked[1:]]
        if marked[:1] == "\t":  # marks behind letters
            return self.first[marked[1:]]
        return self.later[marked]

    def words(self, marked: list[str]) -> list[bytes]:
        """Ids of distinct words.  New ones of Latin letters go to the model in
        rows: no merge reaches over a blank, so a token that starts with one
        starts the next word."""
        found = list(map(self.later.get, marked))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                if self.rows and _LETTERS.fullmatch(marked[i]):
                    new.append(i)
                else:
                    found[i] = self.word(marked[i])
        if new:
            units = [self.later.blank_unit + _units(marked[i]) for i in new]
            rows = ["".join(units[i:i + _ROW]) for i in range(0, len(units), _ROW)]
            ids = np.array([i for e in self.raw.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids], "<u4")
            cuts = np.append(np.flatnonzero(self.starts[ids]), len(ids)) * 4
            data = ids.tobytes()
            for i, a, z in zip(new, cuts.tolist(), cuts[1:].tolist(), strict=False):
                found[i] = data[a:z]
                if len(self.later) < CACHE and len(marked[i]) <= 64:
                    self.later[marked[i]] = found[i]
        return found

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.
        Arrow splits the texts and numbers their distinct words; only those
        are encoded, and numpy puts their ids in place."""
        odd = pc.match_substring_regex(texts, self.unusual).to_numpy(zero_copy_only=False)
        mark, end = pa.scalar("\r", pa.large_string()), pa.scalar("", pa.large_string())
        plain = pc.binary_join_element_wise(mark, texts.filter(pa.array(~odd)), end)
        plain = pc.replace_substring(plain, "\n", " \n")
        plain = pc.replace_substring_regex(plain, _MARKS, "\\1 \t\\2\\3")
        lists = pc.split_pattern(plain, " ")
        coded = lists.flatten().dictionary_encode()
        found = self.words(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy(zero_copy_only=False)
        held = sizes[codes]
        upto = np.concatenate(([0], np.cumsum(held)))
        begin = (np.cumsum(sizes) - sizes)[codes]
        ids = flat[np.repeat(begin - upto[:-1], held) + np.arange(upto[-1])].tobytes()
        cuts = (4 * upto[np.asarray(lists.offsets) - lists.offsets[0].as_py()]).tolist()
        spans = iter(zip(cuts, cuts[1:]))
        out = []
        for i, is_odd in enumerate(odd.tolist()):
            a, z = (0, 0) if is_odd else next(spans)
            out.append(self.odd(texts[i].as_py()) if is_odd else ids[a:z])
        return out


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE writes bytes as characters: printable Latin-1 ones as
    themselves, the others, in order, as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_ALPHABET = _byte_alphabet()
def _units(word: str) -> str:
    """A word in the byte alphabet."""
    return word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_BYTE_ALPHABET)


_ROW = 64
_LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
#: The byte alphabet of _LETTERS: ASCII, the lead bytes C3 to C9, and those that follow.
_LATIN_UNIT = "[A-Za-z\u00C3-\u00C9\u0122-\u0143\u00A1-\u00AC\u00AE-\u00BF]"
#: Latin letters are one piece, and so are the marks behind them.
_LATIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\\[-`{-~]*)")


def _encoder(path: str) -> Encoder:
    """This worker process' encoder for ``path``; it outlives the task."""
    held = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders"))
    if path not in held.__dict__:
        held.__dict__[path] = Encoder(path)
    return held.__dict__[path]


def record(part: int, before: int, doc_ids: list[int | None], chunks: list[bytes]) -> bytes:
    """One record of documents with these ids (little-endian, 32 bits each)."""
    ids = np.frombuffer(b"".join(chunks), "<u4")
    words, firsts, escaped = pack(ids)
    head = [MAGIC, part, before, len(doc_ids), len(ids), len(firsts), len(words), len(escaped)]
    return b"".join(np.asarray(x, t).tobytes() for x, t in (
        (head, "<u8"), ([d or 0 for d in doc_ids], "<i8"), ([d is None for d in doc_ids], "<u8"),
        ([len(c) // 4 for c in chunks], "<u8"), (firsts, "<u8"), (words, "<u8"), (escaped, "<u8")))


def records(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(head, body) of every record of a file, as words."""
    all_words, at = np.frombuffer(data, "<u8"), 0
    end = int.from_bytes(SEPARATOR.encode(), "little")
    while at < len(all_words):
        head = all_words[at:at + _HEAD]
        if int(head[0]) == TRAILER:
            at += 6
            continue
        if int(head[0]) != MAGIC:
            raise ValueError("not a token file")
        _, _, _, docs, _, blocks, words, escapes = map(int, head)
        size = 3 * docs + blocks + words + escapes
        body = all_words[at + _HEAD:at + _HEAD + size]
        at += _HEAD + size + 1
        if int(all_words[at - 1]) != end:
            raise ValueError("a token file ends inside a record")
        yield head, body


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode ``docs`` with the tokenizer file ``tokenizer`` (a path that every
    executor has) and write the files under ``path``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, chunks, held = [], [], 0
        empty = True
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).fill_null("")
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts)):
                chunks.append(ids + end)
                doc_ids.append(doc_id)
                held += len(chunks[-1]) // 4
                empty = False
                if held >= RECORD_IDS:
                    yield _frame(record(part, before, doc_ids, chunks))
                    before, doc_ids, chunks, held = before + held, [], [], 0
        if doc_ids:
            yield _frame(record(part, before, doc_ids, chunks))
        if not empty:
            yield _frame(b"S8B-PART%016d%016d" % (part, before + held))

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    frames = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text") \
        .mapInArrow(run, "frame binary")
    # a cast to string keeps the bytes as they are, and the writer writes them unchanged
    out = frames.select(F.col("frame").cast("string").alias("value"))
    with small_batches(docs.sparkSession, BATCH_BYTES):
        out.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", RECORDS).text(path)


def _frame(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start: ids of all documents before it, n_tokens, ids: as
    little-endian unsigned 32-bit integers) of every document under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for head, body in records(content.as_py()):
                    yield _rows(head, body)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    end = F.substring("content", -48, 40).cast("string")
    totals = files.select(end.alias("end")).where(F.col("end").startswith("S8B-PART")).select(
        F.substring("end", 9, 16).cast("long").alias("part"), F.substring("end", 25, 16).cast("long").alias("n"))
    # one row per part; the number of parts is that of the writing tasks
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base")), "token-bases")
    docs = files.mapInArrow(run, "part long, doc_id long, place long, n_tokens long, ids binary")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def _rows(head: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    _, part, before, docs, n, blocks, n_words, _ = map(int, head)
    doc_ids, nulls, counts, firsts, words, escaped = np.split(
        body, np.cumsum([docs, docs, docs, blocks, n_words]))
    ids = unpack(words, firsts.astype(np.int64), n, escaped).astype("<u4").tobytes()
    ends = np.cumsum(counts.astype(np.int64))
    starts = ends - counts.astype(np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(docs, part), pa.int64()), pa.array(doc_ids.view("<i8"), mask=nulls.astype(bool)),
        pa.array(before + starts), pa.array(counts.astype(np.int64)),
        pa.array([ids[4 * a:4 * z] for a, z in zip(starts.tolist(), ends.tolist())], pa.binary())],
        names=["part", "doc_id", "place", "n_tokens", "ids"])
