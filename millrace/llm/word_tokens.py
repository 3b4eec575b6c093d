"""Token ids of whole texts, for tokenizers that drop white space and never join words across it."""

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokenizer's pattern of the vocabulary file, for code points under 592 (where ``\\w`` holds letters, numbers and ``_``).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+"
BEYOND = "\u0250"
TOKENS = "doc_id long, ids binary, terms array<int>, counts array<long>, docs long, tokens long"


class WordTokens:
    """Ids of texts as little-endian unsigned numbers of ``width`` bytes (2 where the vocabulary allows it).

    Texts are cut at spaces and line ends and each distinct word is tokenized once; up to
    ``keep`` words are remembered. Words of code points under 592 are split
    and lower-cased here and given to the tokenizer's model, all others to the whole tokenizer.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.packed = [k.to_bytes(self.width, "little") for k in range(size)]
        both, one = self._whole("and the"), self._whole("and") + self._whole("the")
        if both != one:
            raise ValueError("this tokenizer does not treat words one by one")
        self.model, self.keep = self.tokenizer.model, keep
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.split = re.compile(PIECES).findall
        # bytes that are printable in Latin-1 stand for themselves, the others for code points from 256
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: chr(b if b in shown else next(rest)) for b in range(256)}

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            spelled = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            packed = self.packed
            got = self.pieces[piece] = b"".join([packed[t.id] for t in self.model.tokenize(spelled)])
        return got

    def _word(self, word: str) -> bytes:
        if word.isascii() or (max(word) < BEYOND and "İ" not in word):
            if word.isalpha():
                got = self._piece(word.lower())
            elif word.isprintable() and "<|" not in word:
                got = b"".join(map(self._piece, self.split(word.lower())))
            else:
                got = self._whole(word)
        else:
            got = self._whole(word)
        self.words[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if len(self.words) > self.keep:
            self.words, self.pieces = {"": b""}, {}
        known = self.words
        out = []
        for word in text.replace("\n", " ").split(" "):
            got = known.get(word)
            out.append(self._word(word) if got is None else got)
        return b"".join(out)


@cache
def _of_worker(path: str) -> WordTokens:
    return WordTokens(path)


def width(path: str) -> str:
    """NumPy type of the ids in ``tokens``."""
    return f"<u{_of_worker(path).width}"


def terms(ids: list[np.ndarray], keyed: np.dtype = np.dtype(np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents: document number, term and count, by document and term."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    bits = keyed.type(8 * keyed.itemsize // 2)
    key = np.sort(np.repeat(np.arange(len(ids), dtype=keyed), lengths) << bits | flat.astype(keyed))
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(head, len(key)))
    key = key[head]
    return (key >> bits).astype(np.int64), (key & ((keyed.type(1) << bits) - keyed.type(1))).astype(np.int64), count


def tokens(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", end: int = 2) -> DataFrame:
    """doc_id and ``ids`` (binary, of type ``width``) of each row, the id ``end`` last; a null text is empty.

    Each task adds a row without ids that counts what it has read: in how many rows each term occurs
    (``terms``, ``counts``), ``docs`` and ``tokens``.
    """
    import pyarrow as pa

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def task(batches):
        ids = _of_worker(path)
        last, kind = end.to_bytes(ids.width, "little"), np.dtype(f"<u{ids.width}")
        total, n_docs, n_tokens = np.zeros(len(ids.packed), np.int64), 0, 0

        def out(doc_id, found, term=None, count=None, n=None, m=None):
            rest = [pa.array([x] * len(doc_id), t) for x, t in ((term, pa.list_(pa.int32())), (count, pa.list_(pa.int64())), (n, pa.int64()), (m, pa.int64()))]
            return pa.RecordBatch.from_arrays([doc_id, found, *rest], ["doc_id", "ids", "terms", "counts", "docs", "tokens"])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):  # few texts at a time in Python's memory
                part = batch.slice(k, 500)
                found = [ids(t) + last for t in part.column(1).to_pylist()]
                own = [np.frombuffer(x, kind) for x in found]
                n_docs, n_tokens = n_docs + len(own), n_tokens + sum(map(len, own))
                total += np.bincount(terms(own, np.dtype(np.uint32 if ids.width == 2 else np.uint64))[1], minlength=len(total))
                yield out(part.column(0), pa.array(found, pa.binary()))
        at = np.flatnonzero(total)
        yield out(pa.array([None], pa.int64()), pa.array([None], pa.binary()), at.tolist(), total[at].tolist(), n_docs, n_tokens)

    return rows.mapInArrow(task, TOKENS)
