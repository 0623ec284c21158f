"""Matching records of the same work across sources that share no key.

Records, their attributes (title, authors, identifiers) and the tokens of these make a
graph. Random walks over all of it, block of records by block, train skip-gram vectors
of all tokens from pseudo-random ones; a token's vectors are averaged over the blocks by
the number of its records. Records are blocked by multi-table hyperplane
hashing: each table hashes the vector of another part of the record (an author with one
title word, the opening of the title, an identifier, and so on), so a part that two
records share puts them into one bucket whatever noise the rest has. Pairs that meet are
reranked exactly on their fields, and the cosines of whole records, estimated from
signatures of hyperplane bits, are calibrated to confidences on all pairs with a label and measured on
pairs held out of the fit. Every pair that meets is checked: no cosine stands before the check.
"""

from __future__ import annotations

import functools
import html
import os
import re
import shutil
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.scratch import drop, root, stage

from .names import _LETTERS, _one_edit

#: Records whose graph a task holds at once; every record is in one such block.
BLOCK = 50_000
#: Files of the vocabulary at most.
PARTS = 256
DIM, BITS, SIGNATURE = 48, 40, 63
#: Share of the trained vector beside the start vector, which keeps tokens of like use apart.
BLEND = 0.3
#: Works whose years are further apart are different ones, unless they share an identifier.
YEARS = 2
#: A bucket that would give more pairs is split by further tokens of its records.
MAX_PAIRS = 4_000
#: Rows of one bucket that a task holds at most; a bucket with more is split.
MAX_HELD = 50_000
#: Rows of either side in one cell of the grid that a bucket still crowded after that is cut into.
CELL = 2_000
#: Entries of a task's dictionaries of parsed names and words.
MEMORY = 200_000

_TAG = re.compile(r"</?\w+/?>|\\[a-zA-Z]+\s*\{|[{}$]")
_LISTED = re.compile(r"[\[(]\s*(?:preprint|v\d+|version \d+|in press|early access)\s*[\])]|^\W*preprint\s*:|,?\s*arxiv[\s:]\d{4}\.\d{4,5}")
_NAME_WORD, _ASCII_NAME_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*"), re.compile("[a-z]+(?:-[a-z]+)*")
_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+|\d+"), re.compile("[a-z]+|[0-9]+")
_CUT = re.compile(r"(?:\.{2,}|…)\W*$")
_DOI = re.compile(r"10\.(\d{4,9})/+(\S*\w)")
_ARXIV = re.compile(r"(\d{4}\.\d{4,5})(?:v\d+)?")
# Words that make a title name another work than the title without them.
_OTHER_WORK = frozenset("correction corrigendum erratum addendum retraction reply comment revisiting ii iii iv vi vii viii edition supplement".split())
_LONG_MARKS = tuple(w for w in _OTHER_WORK if len(w) > 7)
_JUNK_NAMES = frozenset("dr prof mr mrs ms jr sr phd the of for and university institute laboratory collaboration collab consortium research univ inst lab res".split())


@functools.lru_cache(maxsize=200_000)
def _marks_of(word: str) -> tuple[str, ...]:
    """The word if it marks another work, or the long mark that it is a mistyped form of."""
    if word in _OTHER_WORK or word.isdigit():
        return (word,)
    return tuple(m for m in _LONG_MARKS if abs(len(word) - len(m)) < 2 and _one_edit(word, m))


def title_words(title: str | None) -> tuple[list[str], list[str], bool]:
    """(words, marks, cut): folded words, what tells the work from its sequels, whether the end is cut off."""
    t = html.unescape(title or "")
    if "<" in t or "\\" in t or "$" in t or "{" in t or "}" in t:
        t = _TAG.sub("", t)
    t = t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold().replace("​", "")
    if "(" in t or "[" in t or "preprint" in t or "arxiv" in t:
        t = _LISTED.sub(" ", t)
    cut = t[-9:].find("..") >= 0 or "…" in t[-9:]
    cut = cut and bool(_CUT.search(t))
    words = (_ASCII_WORD if t.isascii() else _WORD).findall(t)
    marks = [m for w in words for m in _marks_of(w)]
    if len(words) > 3 and words[-2] == "at" and _one_edit(words[-1], "scale"):
        marks.append("scale")
    return words, sorted(marks), cut


def family_names(names: list[str | None] | None, known: dict[str, str]) -> list[str]:
    """Folded family names, or the telling word of an organisation; blank names left out."""
    out = []
    for name in names or ():
        if not name:
            continue
        got = known.get(name)
        if got is None:
            plain = html.unescape(name) if "&" in name else name
            if "," in plain and plain.split(",")[1].strip(" .;*†"):
                plain = plain.split(",")[0]
            low = plain.casefold()
            if not low.isascii():
                low = "".join([c for c in unicodedata.normalize("NFKD", low.translate(_LETTERS)) if not unicodedata.combining(c)])
            words = (_ASCII_NAME_WORD if low.isascii() else _NAME_WORD).findall(low)
            words = [w for w in words if w not in _JUNK_NAMES] or words
            long = [w for w in words if len(w) > 3] or words
            if len(known) >= MEMORY:
                known.clear()
            got = known[name] = max(long[-2:], key=len) if len(words) > 1 and len(words[-1]) <= 3 else (long[-1] if long else "")
        if got:
            out.append(got)
    return out


def clean_doi(doi: str | None) -> str:
    m = _DOI.search(unquote(doi).lower().replace(" ", "")) if doi else None
    return f"{m.group(1)}/{m.group(2)}" if m and m.group(1).strip("0") else ""


def clean_arxiv(ref: str | None) -> str:
    m = _ARXIV.search(ref) if ref else None
    return m.group(1) if m else ""


def _hash(token: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(token) & 0x7FFFFFFFFFFFFFFF


class Vocabulary:
    """What the whole corpus taught of each token, in files of the shared folder that are mapped and not loaded.

    ``parts`` are the files that there are: of all tokens whose hashes begin with the same bits.
    """

    ROW = np.dtype([("n", "<i8"), ("v", "<f2", (DIM,))])

    def __init__(self, path: str, shift: int, parts: Iterable[int]):
        self.path, self.shift, self.parts = path, shift, frozenset(parts)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` of the tokens that the corpus has, their rows)."""
        at, rows = [np.zeros(0, np.int64)], [np.zeros(0, self.ROW)]
        part = hashes >> self.shift
        for k in np.unique(part).tolist():
            if k not in self.parts:
                continue
            if k not in self.open:
                self.open[k] = tuple(np.load(f"{self.path}/{k}-{what}.npy", mmap_mode="r") for what in ("hashes", "rows"))
            known, found = self.open[k]
            here = np.flatnonzero(part == k)
            place = np.minimum(np.searchsorted(known, hashes[here]), len(known) - 1)
            same = known[place] == hashes[here]
            at.append(here[same])
            rows.append(found[place[same]])
        return np.concatenate(at), np.concatenate(rows)


class Vectors:
    """Token vectors: start values made from the token's hash and what walks taught.

    Tokens that are common in the corpus of so many records weigh less in a record: the
    square root of the inverse document frequency, scaled to about 1 for the rarest. All
    that aren't of the vocabulary weigh 1.
    """

    def __init__(self, vocabulary: Vocabulary | dict, records: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.base = rng.standard_normal((4096, DIM)).astype(np.float32)
        self.planes = rng.standard_normal((DIM, BITS)).astype(np.float32)
        self.signs = rng.standard_normal((DIM, SIGNATURE)).astype(np.float32)
        self.vocabulary, self.records = vocabulary, records

    def start(self, h: np.ndarray) -> np.ndarray:
        return self.base[h & 4095] + self.base[(h >> 12) & 4095] + self.base[(h >> 24) & 4095]

    def of(self, tokens: Iterable[str]) -> np.ndarray:
        """One row a token."""
        hashes = np.array([_hash(t) for t in tokens], np.int64)
        v = self.start(hashes)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
        if self.vocabulary:
            at, rows = self.vocabulary.look_up(hashes)
            w = v[at] + np.float32(BLEND) * rows["v"].astype(np.float32)
            weights = np.sqrt(np.log(max(self.records, 2) / rows["n"]) / np.log(max(self.records, 2)) + 0.02)
            v[at] = w * (weights / np.linalg.norm(w, axis=1))[:, None].astype(np.float32)
        return v


#: Walks of a batch, whose steps are added up together.
WALKS = 410
#: Updates of one token in a batch that are summed in full; more of them share the step of so many, else a token of most records would run away.
STEPS = 64


def _share(rows: np.ndarray, times: np.ndarray) -> np.ndarray:
    return (STEPS / np.maximum(times[rows], STEPS)).astype(np.float32)


def _add(to: np.ndarray, rows: np.ndarray, what: np.ndarray, places: np.ndarray) -> None:
    """Adds rows that may repeat, two numbers at a time; ``places`` is overwritten."""
    at = np.add((rows * (DIM // 2))[:, None], np.arange(DIM // 2), out=places[: len(rows)])
    np.add.at(to.view(np.complex64).reshape(-1), at.reshape(-1), what.view(np.complex64).reshape(-1))


def train_vectors(code: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, walks: int = 3, length: int = 6, rounds: int = 3, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, skip-gram vectors) with negative sampling over walks token - record - token; tokens that are alone in their records have none.

    ``code`` are the tokens of one record after the other, as places in ``hashes``. A step
    of a walk is read and written once for both of its neighbours: arrays hold the first
    steps of all walks of the batch, then the second ones, so that neighbours are slices.
    """
    rng = np.random.default_rng(seed)
    code, sizes = code[np.repeat(sizes, sizes) > 1], sizes[sizes > 1]
    count = np.bincount(code, minlength=len(hashes))
    tokens = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]  # rows of common ones lie together
    if not len(tokens):
        return tokens, np.zeros((0, DIM), np.float32)
    number = np.zeros(len(hashes), np.int64)
    number[tokens] = np.arange(len(tokens))
    flat, count = number[code], count[tokens]
    begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    by_token, first = np.argsort(flat, kind="stable"), np.cumsum(count) - count
    here = np.tile(np.arange(len(sizes)), walks)
    steps = np.empty((length, len(here)), np.int64)
    for i in range(length):
        steps[i] = token = flat[begin[here] + (rng.random(len(here)) * sizes[here]).astype(np.int64)]
        here = owner[by_token[first[token] + (rng.random(len(here)) * count[token]).astype(np.int64)]]
    inner = Vectors({}, 0, seed).start(hashes[tokens]) / np.float32(np.sqrt(3 * DIM))
    outer = inner.copy()
    noise = np.cumsum(count**0.75)
    pairs, neighbours = 2 * (length - 1), np.full(length, 2.0)
    neighbours[[0, -1]] = 1
    rate = np.float32(0.05)
    held = [np.empty((n * WALKS, DIM), np.float32) for n in (length, length, pairs, length, length, length - 1)]
    places = np.empty((pairs * WALKS, DIM // 2), np.int64)
    for _ in range(rounds):
        walk = steps[:, rng.permutation(steps.shape[1])]
        # A noise token for each pair; looked up in order, which is faster, and shuffled.
        draws = noise.searchsorted(np.sort(rng.random(pairs * steps.shape[1])) * noise[-1], side="right")
        draws = rng.permutation(np.minimum(draws, len(tokens) - 1)).reshape(pairs, -1)
        for low in range(0, walk.shape[1], WALKS):
            t, n = walk[:, low : low + WALKS].reshape(-1), draws[:, low : low + WALKS].reshape(-1)
            k = len(t) // length
            f = len(t) - k
            x, y, z, dx, dy, w = (a[:size] for a, size in zip(held, (len(t), len(t), len(n), len(t), len(t), f)))
            for table, rows, out in ((inner, t, x), (outer, t, y), (outer, n, z)):
                table.take(rows, 0, out=out, mode="clip")
            share = _share(t, np.bincount(t, np.repeat(neighbours, k)))
            share_n = _share(n, np.bincount(n))
            dx[f:], dy[:k] = 0, 0
            for back, (c, o) in enumerate(((slice(f), slice(k, None)), (slice(k, None), slice(f)))):
                vc, vx, vn = x[c], y[o], z[back * f : back * f + f]
                good = rate / (1 + np.exp(np.clip(np.einsum("ij,ij->i", vc, vx), -30, 30)))
                bad = -rate / (1 + np.exp(np.clip(-np.einsum("ij,ij->i", vc, vn), -30, 30)))
                if back:
                    dx[c] += np.multiply(vx, (good * share[c])[:, None], out=w)
                    dy[o] += np.multiply(vc, (good * share[o])[:, None], out=w)
                else:
                    np.multiply(vx, (good * share[c])[:, None], out=dx[c])
                    np.multiply(vc, (good * share[o])[:, None], out=dy[o])
                dx[c] += np.multiply(vn, (bad * share[c])[:, None], out=w)
                np.multiply(vc, (bad * share_n[back * f : back * f + f])[:, None], out=vn)
            for table, rows, what in ((inner, t, dx), (outer, t, dy), (outer, n, z)):
                _add(table, rows, what, places)
    inner -= inner.mean(0)
    inner /= np.linalg.norm(inner, axis=1, keepdims=True) + 1e-9
    return tokens, inner


LEARNED = "token long, part int, n long, m long, v array<float>"


def _learn(shift: int, block: int) -> object:
    """Of each block of records, each token's hash, records and trained vector (``m`` is its weight, 0 without one); at token -1 the number of records."""

    def rows(batches: list) -> object:
        import pyarrow as pa

        # What a record's vector is made of; identifiers stay out of it, because they label the pairs that it is calibrated on.
        records = sum(b.num_rows for b in batches)
        words, word, of_word = _coded(pa.concat_arrays([b.column(0) for b in batches]))
        names, name, of_name = _coded(pa.concat_arrays([b.column(1) for b in batches]))
        hashes = np.array([_hash("t:" + w) for w in words] + [_hash("a:" + n) for n in names], np.int64)
        owner, code = np.r_[of_word, of_name], np.r_[word, name + len(words)]
        order = np.argsort(owner, kind="stable")
        n = np.bincount(np.unique(owner * len(hashes) + code) % max(len(hashes), 1), minlength=len(hashes))
        trained, vectors = train_vectors(code[order], np.bincount(owner, minlength=records), hashes)
        m, v = np.zeros(len(hashes) + 1, np.int64), np.zeros((len(hashes) + 1, DIM), np.float32)
        m[trained + 1], v[trained + 1] = n[trained], vectors
        hashes, counts = np.r_[-1, hashes], np.r_[records, n]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * DIM, pa.int32()), pa.array(v.ravel(), pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(hashes >> shift, pa.int32()), pa.array(counts), pa.array(m), lists], [c.split()[0] for c in LEARNED.split(", ")])

    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, block - n))
                batch, n = batch.slice(block - n), n + held[-1].num_rows
                if n == block:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return run


def _write(path: str, shift: int) -> object:
    """(part, records) of the parts written from ``LEARNED`` rows in the order of their tokens; each part is made of the means over all blocks."""

    def saved(part: int, chunks: list[tuple]) -> None:
        tokens, n, m, v = (np.concatenate(c) for c in zip(*chunks))
        rows = np.zeros(len(tokens), Vocabulary.ROW)
        v /= np.maximum(m, 1)[:, None]
        rows["n"], rows["v"] = n, v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
        for what, array in (("hashes", tokens), ("rows", rows)):
            new = f"{path}/{part}-{what}-{uuid.uuid4().hex}"
            with open(new, "wb") as f:
                np.save(f, array)
            os.replace(new, f"{path}/{part}-{what}.npy")  # a task that runs again writes the same

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(part: int, records: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([records], pa.int64())], ["part", "records"])

        os.makedirs(path, exist_ok=True)
        chunks, last = [], None
        for batch in batches:
            tokens, n, m = (batch.column(i).to_numpy() for i in range(3))
            v = batch.column(3).flatten().to_numpy().reshape(-1, DIM) * m[:, None].astype(np.float32)
            if last is not None:  # its rows may go on
                tokens, n, m, v = (np.concatenate(x) for x in zip(last, (tokens, n, m, v)))
            if not len(tokens):
                continue
            begin = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            tokens, n, m, v = tokens[begin], *(np.add.reduceat(x, begin, axis=0) for x in (n, m, v))
            last = tokens[-1:], n[-1:], m[-1:], v[-1:]
            done = np.flatnonzero(np.r_[True, np.diff(tokens[:-1] >> shift) != 0]) if len(tokens) > 1 else []
            for low, high in zip(done, [*done[1:], len(tokens) - 1]):
                if chunks and chunks[-1][0][0] >> shift != tokens[low] >> shift:
                    yield finished(chunks, told)
                    chunks = []
                chunks.append((tokens[low:high], n[low:high], m[low:high], v[low:high]))
        if last is not None:
            if chunks and chunks[-1][0][0] >> shift != last[0][0] >> shift:
                yield finished(chunks, told)
                chunks = []
            yield finished([*chunks, last], told)

    def finished(chunks: list[tuple], told) -> object:
        part = int(chunks[0][0][0] >> shift)
        if part < 0:
            return told(part, int(sum(c[1].sum() for c in chunks)))
        saved(part, chunks)
        return told(part, 0)

    return run


def learn(parsed: DataFrame, block: int = BLOCK) -> tuple[Vocabulary, int]:
    """The vocabulary of every token of all records, and the number of records.

    Walks stay within a block of records that one task holds; counts are exact. Only the
    names of at most ``PARTS`` files reach the driver.
    """
    spark = parsed.sparkSession
    path = f"{root(spark)}/vocabulary-{uuid.uuid4().hex[:12]}".removeprefix("file://")
    if not path.startswith("/"):
        raise ValueError("spark.checkpoint.dir has to be a mounted folder: the vocabulary's files are mapped into memory")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shift = 63 - min(PARTS - 1, max(tasks - 1, 1)).bit_length()
    learned = parsed.select("words", "names").mapInArrow(_learn(shift, block), LEARNED)
    ordered = learned.repartition(tasks, "part").sortWithinPartitions("token", "n", "m", "v").select("token", "n", "m", "v")
    parts = ordered.mapInArrow(_write(path, shift), "part int, records long").collect()
    return Vocabulary(path, shift, (r["part"] for r in parts if r["part"] >= 0)), sum(r["records"] for r in parts)


def _listed(column) -> list:
    """The texts or truth values of a column; ``to_pylist`` makes an object of Arrow's for each first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _coded(column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words in order, their places in it, row of each) of a column of words joined by spaces."""
    import pyarrow.compute as pc

    lists = pc.split_pattern(column, " ")
    coded = lists.flatten().dictionary_encode()
    words, code = _listed(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(column)), lists.value_lengths().to_numpy())
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.zeros(len(words), np.int64)
    place[order] = np.arange(len(words))
    words, code = [words[i] for i in order], place[code]
    if words and not words[0]:
        words, code, owner = words[1:], code[code > 0] - 1, owner[code > 0]
    return words, code, owner


@functools.lru_cache(maxsize=200_000)
def _orders(word: str) -> tuple[int, int, int, int]:
    """Places of a word in four random orders of all words."""
    return _hash("1" + word), _hash("2" + word), _hash("3" + word), _hash("4" + word)


def _ends(name: str) -> list[str]:
    """The first and the last letters of a name: one mistyped letter leaves one of them."""
    return ["^" + name[:6], name[-6:] + "$"] if len(name) > 7 else ["^" + name[:4]]


PLACED = "rec_id long, side int, keys array<long>, sign long, bag long, words string, marks string, cut boolean, names string, year int, doi string, arxiv string"


def _raw(records: DataFrame) -> DataFrame:
    openalex = F.col("source").eqNullSafe("openalex")
    return records.select(
        F.col("rec_id").cast("long"),
        openalex.cast("int").alias("side"),
        F.coalesce("title", "display_name").alias("title"),
        F.coalesce("authors.name", "authorships.author.display_name").alias("names"),
        F.coalesce("year", "publication_year").cast("int").alias("year"),
        F.coalesce("doi", "externalids.doi").alias("doi"),
        F.coalesce("arxiv_id", "externalids.arxiv", F.when(F.col("source") == "arxiv", F.col("source_record_id"))).alias("arxiv"),
    )


def _bits(sums: np.ndarray) -> np.ndarray:
    """The signs of each row's sums as one number."""
    packed = np.zeros((len(sums), 8), np.uint8)
    got = np.packbits(sums > 0, axis=1, bitorder="little")
    packed[:, : got.shape[1]] = got
    return packed.view(np.int64)[:, 0]


def _once(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without a row's repeated words, in the order in which they come first."""
    first = np.sort(np.unique(owner * (code.max(initial=0) + 1) + code, return_index=True)[1])
    return code[first], owner[first]


def _by_word(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((code, owner))
    return code[order], owner[order]


def _crossed(rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): each place of ``rows``, which are rows, with every place of the sorted ``owner`` of the same row."""
    size = np.bincount(owner, minlength=n)
    times = size[rows]
    x = np.repeat(np.arange(len(rows)), times)
    return x, np.arange(len(x)) + np.repeat((np.cumsum(size) - size)[rows] - np.cumsum(times) + times, times)


def _sums(vectors: np.ndarray, code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Each row's sum of its words' vectors, added in their order: first all first words, then all second ones."""
    size = np.bincount(owner, minlength=n)
    begin, out = np.cumsum(size) - size, np.zeros((n, vectors.shape[1]), np.float32)
    rows = np.flatnonzero(size)
    for i in range(size.max(initial=0)):
        rows = rows[size[rows] > i]
        out[rows] += vectors[code[begin[rows] + i]]
    return out


def _part_keys(words, marks, names, doi, arxiv, side, year, vectors: Vectors, told: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key) of every part of the records in these columns, and the records' signatures.

    A key holds 47 bits of the part's hash, one that says whether the part is an
    identifier, 15 of the year (0 where it is unknown) and one of the side. ``told`` gets
    the tokens of each part.
    """
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    ids = [[(i, f"{kind}{x}") for i, x in enumerate(_listed(column)) if x] for kind, column in enumerate((doi, arxiv))]
    ids = ids[0] + ids[1]
    # Records with other marks describe other works, so they needn't meet.
    salt = np.array([_hash(m) if m else 0 for m in _listed(marks)], np.int64)
    side = side.to_numpy().astype(np.int64)
    word, all_words, word_owner = _coded(words)
    name, all_names, name_owner = _coded(names)
    # The telling words are the longer ones, if there are any.
    code, owner = _once(all_words, word_owner)
    long = np.array([len(w) > 3 for w in word], bool)[code]
    telling = long | (np.bincount(owner[long], minlength=n) == 0)[owner]
    code, owner = code[telling], owner[telling]
    size = np.bincount(owner, minlength=n)
    rows, begin = np.flatnonzero(size), np.cumsum(size) - size
    place = np.arange(len(code)) - begin[owner]
    orders = np.array([_orders(w) for w in word], np.int64).reshape(-1, 4)[code].T
    anchor = place == 0
    for order in orders[:3] if len(code) else ():
        least = np.zeros(n, np.int64)
        least[rows] = np.minimum.reduceat(order, begin[rows])
        anchor |= order == least[owner]
    ordered = np.lexsort((orders[3], owner))
    some = ordered[place < 3]
    people, who = _once(all_names, name_owner)
    crowd = np.bincount(who, minlength=n)
    # An author and a title word; a lone author's name by its ends, as one mistyped letter would part them.
    near, near_owner = code[anchor], owner[anchor]
    one, two = _crossed(who, near_owner, n)
    ends = [_ends(x) for x in name]
    stem = sorted({e for x in ends for e in x})
    number = {e: i for i, e in enumerate(stem)}
    of_name = np.repeat(np.arange(len(name)), [len(x) for x in ends])
    lone = np.flatnonzero((crowd[who] == 1) & (size[who] > 0))
    person, end = _crossed(people[lone], of_name, len(name))
    end = np.array([number[e] for x in ends for e in x], np.int64)[end]
    person = lone[person]
    three, four = _crossed(who[person], near_owner, n)
    # Title words alone bring together what has no authors and anything else.
    parts = [_by_word(code, owner), _by_word(code[place < 3], owner[place < 3]), _by_word(code[some], owner[some])]
    alone = size[who] == 0  # the authors alone
    parts.append(_by_word(people[alone], who[alone]))

    def matrix(kind: str, tokens: list[str], planes: np.ndarray) -> np.ndarray:
        return vectors.of([kind + t for t in tokens]) @ planes if tokens else np.zeros((1, planes.shape[1]), np.float32)

    both = np.hstack([vectors.planes, vectors.signs])
    of_words, of_names, of_stems = matrix("t:", word, both), matrix("a:", name, both), matrix("s:", stem, vectors.planes)
    sign = _bits(_sums(of_words[:, BITS:], all_words, word_owner, n) + _sums(of_names[:, BITS:], all_names, name_owner, n))
    of_words, of_names = np.ascontiguousarray(of_words[:, :BITS]), np.ascontiguousarray(of_names[:, :BITS])
    bits = [_bits(_sums(of_names if i == 3 else of_words, *part, n)) for i, part in enumerate(parts)]
    groups = [
        (who[one], _bits(of_names[people[one]] + of_words[near[two]]) * 16 + 2),
        (who[person][three], _bits(of_stems[end[three]] + of_words[near[four]]) * 16 + 3),
        (rows, bits[0][rows] * 16 + 4),
    ]
    listed = [(rows, 0)]
    for k in (0, 1):
        here = rows[(crowd[rows] == 0) | (side[rows] == k)]
        listed += [(here, 1), (here, 2)]
        groups += [(here, bits[1][here] * 16 + 5 + k), (here, bits[2][here] * 16 + 8 + k)]
    here = np.flatnonzero((size == 0) & (crowd > 0))
    groups.append((here, bits[3][here] * 16 + 7))
    owners = np.concatenate([np.array([i for i, _ in ids], np.int64), *(o for o, _ in groups)])
    hashed = np.concatenate([np.array([_hash(x) for _, x in ids], np.int64), *(h ^ salt[o] for o, h in groups)])
    years = year.fill_null(0).to_numpy().astype(np.int64)
    years = np.where((years > 0) & (years < 1 << 15), years, 0)
    is_id = (np.arange(len(owners)) < len(ids)).astype(np.int64)
    keys = (hashed << 17) | (is_id << 16) | (years[owners] << 1) | side[owners]
    if told is not None:
        told += [[x[1:]] for _, x in ids]
        for x, y in ((people[one], near[two]), (people[person][three], near[four])):
            told += [[name[a], word[b]] for a, b in zip(x.tolist(), y.tolist())]
        for at, i in (*listed, (here, 3)):
            of = [[] for _ in range(n)]
            for c, o in zip(*(a.tolist() for a in parts[i])):
                of[o].append((name if i == 3 else word)[c])
            told += [of[i] for i in at.tolist()]
    return owners, keys, sign


PARSED = "rec_id long, side int, bag long, words string, marks string, cut boolean, names string, year int, doi string, arxiv string"


def _parse(batches: Iterator) -> Iterator:
    """``PARSED`` rows of raw records."""
    import pyarrow as pa

    known: dict[str, str] = {}
    for batch in batches:
        lists = batch.column(3)
        names, ends = _listed(lists.flatten()), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())].tolist()
        rest = []
        for title, low, high, doi, arxiv in zip(_listed(batch.column(2)), ends, ends[1:], _listed(batch.column(5)), _listed(batch.column(6))):
            words, marks, cut = title_words(title)
            rest.append((_hash(" ".join(sorted(words))), " ".join(words), " ".join(marks), cut, " ".join(family_names(names[low:high], known)), clean_doi(doi), clean_arxiv(arxiv)))
        bags, words, marks, cuts, people, dois, arxivs = zip(*rest) if rest else ((),) * 7
        text = pa.string()
        columns = [batch.column(0), batch.column(1), pa.array(bags, pa.int64()), pa.array(words, text), pa.array(marks, text), pa.array(cuts, pa.bool_())]
        columns += [pa.array(people, text), batch.column(4), pa.array(dois, text), pa.array(arxivs, text)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PARSED.split(", ")])


def _hash_parts(trained) -> object:
    """``PLACED`` rows of ``PARSED`` ones: hash their parts and sign the whole."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vectors = Vectors(*trained.value)
        for batch in batches:
            owners, keys, sign = _part_keys(*(batch.column(i) for i in (3, 4, 6, 8, 9, 1, 7)), vectors)
            order = np.argsort(owners, kind="stable")
            ends = np.searchsorted(owners[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order], pa.int64()))
            columns = [batch.column(0), batch.column(1), lists, pa.array(sign, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PLACED.split(", ")])

    return run


def _place(trained) -> object:
    """Parse every raw record, hash its parts and sign the whole."""
    placed = _hash_parts(trained)
    return lambda batches: placed(_parse(batches))


def _matched(a: list[str], b: list[str]) -> int:
    """Words of ``a`` that have a partner in ``b``: equal, one edit apart, or an abbreviation of it."""
    left = list(b)
    rest = []
    for w in a:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    n = len(a) - len(rest)
    for w in rest:
        size = len(w)
        if size < 3:
            continue
        first, last = w[0], w[-1]
        for x in left:
            k = len(x)
            # One edit of a longer word leaves its first or its last letter.
            if x[0] != first and x[-1] != last:
                continue
            if (-2 < k - size < 2 and _one_edit(w, x)) or (x.startswith(w) if size < k else k > 2 and w.startswith(x)):
                left.remove(x)
                n += 1
                break
    return n


def _near(a: str, b: str, least: float) -> bool:
    """Whether at least this share of letters is in common order; letters in common in any order are counted first."""
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * both or 2 * sum([min(a.count(c), b.count(c)) for c in set(a)]) < least * both:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= least


def _people(a: list[str], b: list[str]) -> int:
    """Family names in common; longer ones may differ in a fifth of their letters."""
    n = _matched(a, b)
    if n < min(len(a), len(b)):
        n = max(n, sum(any(x == y or (min(len(x), len(y)) > 5 and x[0] == y[0] and _near(x, y, 0.8)) for y in b) for x in a))
    return min(n, len(a), len(b))


def _opens(a: list[str], b: list[str]) -> bool:
    """Whether the words of ``a`` are the first words of the longer ``b``, but for typing errors."""
    if not a or len(a) >= len(b) or (len(a) == 1 and len(a[0]) < 6):
        return False
    return all(x == y or (len(x) > 2 and _one_edit(x, y)) for x, y in zip(a, b))


def _longer_words(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 2 or w.isdigit() or not w.isascii()] or words


def same_work(a: tuple, b: tuple) -> bool:
    """Exact check of a pair: (words, marks, cut, names, year, doi, arxiv) of either record."""
    same_id = bool(a[5] and a[5] == b[5]) or bool(a[6] and a[6] == b[6])
    years = abs(a[4] - b[4]) if a[4] and b[4] else None
    if not same_id and (a[1] != b[1] or (years is not None and years > YEARS)):
        return False
    wa, wb = a[0].split(), b[0].split()
    if not same_id and (not wa or not wb or 3 * len(set(wa) & set(wb)) < min(len(set(wa)), len(set(wb)))):
        return False
    na, nb = a[3].split(), b[3].split()
    if len(wa) > len(wb):
        a, b, wa, wb, na, nb = b, a, wb, wa, nb, na
    other_doi = bool(a[5] and b[5] and a[5] != b[5] and not _one_edit(a[5], b[5]))
    other_arxiv = bool(a[6] and b[6] and a[6] != b[6] and not _one_edit(a[6], b[6]))
    fewer = min(len(na), len(nb))
    people = _people(na, nb) if fewer else 0
    if fewer and 2 * people < fewer and not same_id:
        return False
    if not wa or not wb:
        return same_id and fewer > 0 and 2 * people >= fewer
    opening = a[2] or b[2] or _opens(wa, wb)
    marks_a, marks_b = a[1].split(), b[1].split()
    if marks_a != marks_b:
        cut, whole = (marks_a, marks_b) if a[2] or not b[2] else (marks_b, marks_a)
        kept = list(whole)
        for m in cut:
            if m not in kept:
                return False
            kept.remove(m)
        # Only what a shortened title lost may differ, and only beside the same identifier.
        if not opening:
            return False
    if b[2] and not a[2]:
        part, rest = wb[:-1] or wb, wa
    elif opening:
        part, rest = (wa[:-1] if a[2] and len(wa) > 2 else wa), wb[: len(wa) + 1]
    else:
        part, rest = wb, wa
    unmatched = len(part) - _matched(part, rest)
    if unmatched and not opening:
        part, rest = _longer_words(part), _longer_words(rest)
        unmatched = max(len(part) - _matched(part, rest), 0)
    likeness = 1 - unmatched / max(1, len(part))
    if unmatched and not opening and likeness >= 0.6 and _near("".join(wa), "".join(wb), 0.92):
        likeness, unmatched = 1.0, 0
    if same_id:
        return likeness >= 0.6 if not fewer or 2 * people >= fewer else likeness >= 0.95 and (years or 0) <= 1
    short = len(wb if not opening else part) < 4
    if fewer:
        if other_doi and other_arxiv or (other_doi or other_arxiv) and (short or opening):
            return False
        if short or opening:
            return unmatched == 0 and (years is None or years <= 1 or len(part) > 5)
        return unmatched == 0 or (unmatched == 1 and len(part) > 6 and people == fewer and likeness >= 0.85 and _near("".join(wa), "".join(wb), 0.88))
    return not opening and not short and not other_doi and not other_arxiv and unmatched == 0 and (years is None or years <= 1)


def _checked(pairs: DataFrame) -> DataFrame:
    """(rec_a, rec_b, cosine, same, label): the exact check of the pairs that aren't ``plain``; those are the same work."""
    years = [5 + e * len(FIELDS) + FIELDS.index("year") for e in (0, 1)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            same = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            open_ = np.flatnonzero(~same)
            left = batch.take(pa.array(open_))
            fields = [_listed(left.column(i).fill_null(0) if i in years else left.column(i)) for i in range(5, 19)]
            same[open_] = [same_work(a, b) for a, b in zip(zip(*fields[:7]), zip(*fields[7:]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(same, pa.bool_()), batch.column(3)],
                ["rec_a", "rec_b", "cosine", "same", "label"],
            )

    return pairs.mapInArrow(run, "rec_a long, rec_b long, cosine double, same boolean, label int")


def _labelled(scored: DataFrame) -> np.ndarray:
    """(cosine, label, fold, pairs) of all labelled pairs: a signature has few cosines, so these are few rows."""
    fold = F.pmod(F.xxhash64("rec_a", "rec_b"), F.lit(2)).alias("fold")
    counted = scored.where("label is not null").groupBy("cosine", "label", fold).agg(F.count("*").alias("pairs")).orderBy("cosine", "label", "fold")
    return np.array([tuple(r) for r in counted.collect()], float).reshape(-1, 4)


def _fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    if min(n[y == 1].sum(), n[y == 0].sum()) < 20:
        return 6.0, -3.0
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, design.T @ (n * (y - p)) - 1e-3 * w)
    return float(w[0]), float(w[1])


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and offset of a logistic curve from cosine to the chance of one work.

    Fitted on all pairs whose DOIs say whether they agree; with too few of either kind
    the curve is (6, -3). No cosine contains an identifier.
    """
    x, y, _, n = _labelled(scored).T
    return _fitted(x, y, n)


def held_out(scored: DataFrame) -> dict[str, float]:
    """Brier score of the confidence on one half of the labelled pairs, fitted on the other, beside that of the mean label."""
    got = _labelled(scored)
    (x, y, _, n), (u, v, _, k) = got[got[:, 2] == 0].T, got[got[:, 2] == 1].T
    if not len(n) or not len(k):
        return {"pairs": float(k.sum())}
    slope, offset = _fitted(x, y, n)
    p = 1 / (1 + np.exp(-(u * slope + offset)))
    return {"pairs": float(k.sum()), "brier": float(np.average((p - v) ** 2, weights=k)), "brier_of_the_mean": float(np.average((np.average(y, weights=n) - v) ** 2, weights=k))}


FIELDS = ("words", "marks", "cut", "names", "year", "doi", "arxiv")


def _across(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, crowded buckets) of rows sorted by key: all pairs across the divide of one bucket whose years may be of one work."""
    group = keys >> 16
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(group)]))
    side = (keys & 1).astype(bool)
    nx, ny = np.bincount(number[side], minlength=len(begin)), np.bincount(number[~side], minlength=len(begin))
    crowded = nx * ny > MAX_PAIRS
    xs, ys = np.flatnonzero(side & ~crowded[number]), np.flatnonzero(~side & ~crowded[number])
    ny = np.where(crowded, 0, ny)
    first = np.cumsum(ny) - ny
    times = ny[number[xs]]
    x = np.repeat(xs, times)
    y = ys[np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[number[xs]], times)]
    year_x, year_y = (keys[x] >> 1) & 0x7FFF, (keys[y] >> 1) & 0x7FFF
    fits = ((keys[x] >> 16) & 1).astype(bool) | (year_x == 0) | (year_y == 0) | (np.abs(year_x - year_y) <= YEARS)
    return refs[x[fits]], refs[y[fits]], group[begin[crowded]]


def _meet(batches: Iterator) -> Iterator:
    """(x, y, crowded): pairs of sorted index rows; a bucket too crowded to pair is named in x instead.

    Holds the rows of one bucket at most, and no more than ``MAX_HELD`` of them.
    """
    import pyarrow as pa

    def out(x: np.ndarray, y: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(np.full(len(x), crowded))], ["x", "y", "crowded"])

    keys, refs, given_up = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        keys, refs = np.r_[keys, batch.column(0).to_numpy()], np.r_[refs, batch.column(1).to_numpy()]
        if given_up is not None:
            go = np.searchsorted(keys >> 16, given_up, "right")
            keys, refs = keys[go:], refs[go:]
        if not len(keys):
            continue
        last = np.searchsorted(keys >> 16, keys[-1] >> 16)
        x, y, crowded = _across(keys[:last], refs[:last])
        yield out(x, y, False)
        keys, refs = keys[last:], refs[last:]
        if len(keys) > MAX_HELD:
            given_up = keys[-1] >> 16
            crowded = np.r_[crowded, given_up]
            keys, refs = keys[:0], refs[:0]
        yield out(crowded, crowded, True)
    x, y, crowded = _across(keys, refs)
    yield out(x, y, False)
    yield out(crowded, crowded, True)


def _pieces(token: str) -> list[str]:
    """Beginning and end of a token: one mistyped letter leaves one of them."""
    n = len(token)
    if n < 4:
        return [token]
    return [p for h in ((2,) if n < 6 else (2, 3) if n == 6 else (3,)) for p in ("^" + token[:h], token[-h:] + "$")]


def _split(trained) -> object:
    """(sub, bare, any, key, rec_id) of rows of crowded buckets: under each piece of each token that isn't of the bucket's own part.

    A row without such tokens is bare. It can belong to any row of its bucket, so all
    rows are listed under the empty piece too, where only pairs with a bare row count.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        vectors = Vectors(*trained.value)
        for batch in batches:
            key, words, names = (batch.column(i).to_pylist() for i in (0, 3, 5))
            parts: list[list[str]] = []
            owner, keys, _ = _part_keys(*(batch.column(i) for i in (3, 4, 5, 7, 8, 2, 6)), vectors, parts)
            own = {}
            for i, k, part in zip(owner.tolist(), keys.tolist(), parts):
                if k == key[i]:
                    own[i] = set(part)
            subs, bare, empty, rows = [], [], [], []
            for i in range(len(key)):
                others = {t for t in (*(w for w in words[i].split() if len(w) > 3), *names[i].split()) if t not in own.get(i, ())}
                found = sorted({p for t in others for p in _pieces(t)})
                subs += [_hash(f"{key[i] >> 16} {p}") for p in ("", *found)]
                bare += [not found] * (len(found) + 1)
                empty += [True, *[False] * len(found)]
                rows += [i] * (len(found) + 1)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(subs, pa.int64()), pa.array(bare, pa.bool_()), pa.array(empty, pa.bool_()), batch.column(0).take(at), batch.column(1).take(at)],
                ["sub", "bare", "any", "key", "rec_id"],
            )

    return run


def candidates(placed: DataFrame, trained) -> tuple[DataFrame, list[DataFrame]]:
    """(x, y), and the written tables that it reads: pairs across the divide that share a bucket, each once; all of them within a task where one x is.

    One shuffle by bucket. A bucket that would give more than ``MAX_PAIRS`` pairs is
    split: its records meet under it and a piece of one more of their tokens, of those
    that the bucket isn't made of. What is crowded still is cut into a grid of cells of
    ``CELL`` rows a side, so that no task has more and no pair is lost.
    """
    rows = placed.select(F.explode("keys").alias("key"), "rec_id")
    by = F.shiftright("key", 16)
    met = stage(rows.repartition(by).sortWithinPartitions("key").mapInArrow(_meet, "x long, y long, crowded boolean"), "met", crowded=F.count_if("crowded"))
    pairs, tables = met.where("not crowded").select("x", "y"), [met]
    if met.measured["crowded"]:
        more, split = _crowded_pairs(placed, met.where("crowded").select(F.col("x").alias("bucket")), met.measured["crowded"], trained)
        pairs, tables = pairs.unionByName(more), [met, split]
    return pairs.repartition("x").distinct(), tables


def _crowded_pairs(placed: DataFrame, buckets: DataFrame, n: int, trained) -> tuple[DataFrame, DataFrame]:
    few = F.broadcast(buckets) if n <= 100_000 else buckets
    rows = placed.select(F.explode("keys").alias("key"), "rec_id", "side", "words", "marks", "names", "year", "doi", "arxiv")
    rows = rows.join(few, F.shiftright("key", 16) == F.col("bucket")).drop("bucket")
    split = table = stage(rows.mapInArrow(_split(trained), "sub long, bare boolean, any boolean, key long, rec_id long"), "split")
    side = F.col("key").bitwiseAND(1)
    cells = split.groupBy("sub").agg(F.sum(side).alias("nx"), F.sum(1 - side).alias("ny"))
    cells = cells.where("nx > 0 and ny > 0").select("sub", F.ceil(F.col("nx") / CELL).cast("int").alias("cx"), F.ceil(F.col("ny") / CELL).cast("int").alias("cy"))
    split = split.join(cells, "sub").select("*", F.shiftright("key", 1).bitwiseAND(0x7FFF).alias("year"), F.shiftright("key", 16).bitwiseAND(1).alias("id"))
    own = lambda cells: F.pmod(F.xxhash64("rec_id"), F.col(cells))
    every = lambda cells: F.explode(F.sequence(F.lit(0), F.col(cells) - 1))
    a = split.where(side == 1).select("sub", F.col("rec_id").alias("x"), "any", F.col("bare").alias("bare_x"), F.col("year").alias("year_x"), "id", own("cx").cast("int").alias("i"), every("cy").alias("j"))
    b = split.where(side == 0).select("sub", F.col("rec_id").alias("y"), F.col("bare").alias("bare_y"), F.col("year").alias("year_y"), own("cy").cast("int").alias("j"), every("cx").alias("i"))
    near = (F.col("id") == 1) | (F.col("year_x") == 0) | (F.col("year_y") == 0) | (F.abs(F.col("year_x") - F.col("year_y")) <= YEARS)
    met = a.join(b, ["sub", "i", "j"]).where(near & (~F.col("any") | F.col("bare_x") | F.col("bare_y")))
    return met.select("x", "y"), table


def match_records(records: DataFrame) -> DataFrame:
    """(rec_a, rec_b, cosine, confidence) of records across the divide that describe one work, smaller id first.

    Null titles match by identifier and authors only; records without title, authors and
    identifier match nothing. Repeated rows give a pair each. Empty tables give none.
    """
    spark = records.sparkSession
    parsed = stage(_raw(records).mapInArrow(_parse, PARSED), "parsed")
    vocabulary, n = learn(parsed)
    trained = spark.sparkContext.broadcast((vocabulary, n))
    placed = stage(parsed.mapInArrow(_hash_parts(trained), PLACED), "placed")
    drop(parsed)
    pairs, tables = candidates(placed, trained)
    shutil.rmtree(vocabulary.path, ignore_errors=True)
    scored = score_pairs(placed, pairs)
    drop(placed, *tables)
    slope, offset = calibrate(scored)
    return scored.where("same").select(
        F.least("rec_a", "rec_b").alias("rec_a"),
        F.greatest("rec_a", "rec_b").alias("rec_b"),
        "cosine",
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("cosine") * slope + offset)))).alias("confidence"),
    )


def score_pairs(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec_a, rec_b, cosine, same, label) of candidate pairs, as a written table; refused pairs stay only if they are labelled."""
    fields = ("sign", "bag", *FIELDS)
    left = placed.where("side = 1").select(F.col("rec_id").alias("x"), *(F.col(f).alias(f"{f}_x") for f in fields))
    right = placed.where("side = 0").select(F.col("rec_id").alias("y"), *(F.col(f).alias(f"{f}_y") for f in fields))
    far = F.bit_count(F.col("sign_x").bitwiseXOR(F.col("sign_y")))
    cosine = F.cos(far * F.lit(np.pi / SIGNATURE)).alias("cosine")
    full = pairs.join(left, "x").join(right, "y")
    same_id = ((F.col("doi_x") == F.col("doi_y")) & (F.col("doi_x") != "")) | ((F.col("arxiv_x") == F.col("arxiv_y")) & (F.col("arxiv_x") != ""))
    full = full.where(same_id | (F.col("marks_x") == F.col("marks_y")))
    # What the exact check can only accept needs no Python: the same words, the same names as far as both have them, nothing against it.
    nx, ny = F.split("names_x", " "), F.split("names_y", " ")
    people = (F.col("names_x") != "") & (F.col("names_y") != "") & (F.size(F.array_intersect(nx, ny)) == F.least(F.size(nx), F.size(ny)))
    words = (F.col("words_x") != "") & (F.col("bag_x") == F.col("bag_y"))
    for k in ("doi", "arxiv"):
        words = words & ((F.col(f"{k}_x") == "") | (F.col(f"{k}_y") == "") | (F.col(f"{k}_x") == F.col(f"{k}_y")))
    plain = words & people & F.coalesce(F.abs(F.col("year_x") - F.col("year_y")) <= 1, F.lit(True))
    label = F.when((F.col("doi_x") != "") & (F.col("doi_y") != ""), (F.col("doi_x") == F.col("doi_y")).cast("int")).alias("label")
    full = full.select("x", "y", cosine, label, plain.alias("plain"), *(f"{f}_{e}" for e in "xy" for f in FIELDS))
    open_ = [F.when(~F.col("plain"), F.col(f"{f}_{e}")).alias(f"{f}_{e}") for e in "xy" for f in FIELDS]
    checked = _checked(full.select("x", "y", "cosine", "label", "plain", *open_))
    return stage(checked.where("same or label is not null"), "scored")
