"""Removal of repeated substrings by prefix-free parsing.

Rolling hashes of SEED bytes trigger phrase ends: in each window of `length` bytes the smallest hash (the leftmost on
ties) is a trigger. The windows that share a trigger, with the bytes that they cover, are one phrase, so whether and where
a window is cut depends on its own bytes only, and equal windows lie at the same place of phrases with equal triggers.

1. The parse: tasks send each document's triggers to the bucket of their hash, packed into blobs. A bucket sends back to
   documents which of their triggers other documents have as well.
2. The dictionary: the phrases of such triggers go to the bucket of the trigger. There equal phrases become one entry
   with its smallest document. The entries' suffixes are put into a suffix array down to a depth of `length` bytes
   (prefix doubling, so bytes decide); neighbours in it that have `length` bytes in common are one class, in which the
   smallest document decides.
3. What the classes decide is carried back through the parse to the documents, as byte ranges.

Prefix-free parsing orders suffixes that reach beyond their phrase by the order of the parse. Here a window lies wholly
inside its phrase, and equal windows in phrases of equal triggers, so neither the parse's order nor that of two buckets is
ever asked for, and neither is built.

What documents of one batch have in common is settled in its task: of a trigger the smallest and the largest document go
to the bucket, of a phrase the smallest one, and the others get their answer at once. So a passage that a third of all
documents have costs its bucket two rows for each batch.

Texts are partitioned by document once; the three joins that need them use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import textkit as tk

SEED = 24
_LOW = np.uint64((1 << 40) - 1)
_CODEC = pa.Codec("zstd", compression_level=6)
BUCKET_BYTES = 1 << 25  # text for one bucket, about
SLICES = 8  # parts of a bucket's dictionary that are put into order one after the other


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, bytes of equal weight together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [np.array([len(a), a.dtype.itemsize], np.int64).tobytes(), a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n))
        at += n * size
    return out


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, key) of each phrase, in text order; documents shorter than length have none."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if len(data) < length:
        return none
    seed, width = min(SEED, length), length - min(SEED, length) + 1
    prefix = tk.prefix_hash(data)
    at = np.arange(len(data) - seed + 1)
    h = tk.span_hash(prefix, at, at + seed)
    low = (h & ~_LOW) | at.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = np.flatnonzero(doc[: len(low)] == doc[length - 1 :])
    if not len(ok):
        return none
    trigger = (low[ok] & _LOW).astype(np.int64)
    change = np.flatnonzero((trigger[1:] != trigger[:-1]) | (doc[ok[1:]] != doc[ok[:-1]])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(ok)]]) - 1
    return doc[ok[first]], ok[first], ok[last], tk.mix(h[trigger[first]] ^ np.uint64(0x6A09E667F3BCC909))


def _buckets(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _ordinals(doc: np.ndarray) -> np.ndarray:
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return np.arange(len(doc)) - np.repeat(start, np.diff(np.concatenate([start, [len(doc)]])))


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), part


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    n = len(sorted_by[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in sorted_by])
    return np.flatnonzero(new)


def _over(start: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """One value for each run, repeated over the run."""
    return np.repeat(values, np.diff(np.concatenate([start, [n]])))


def _passed(replies: pa.RecordBatch) -> pa.RecordBatch:
    """Answers that are known before their bucket is asked: they go by it, with negative bucket numbers."""
    return pa.RecordBatch.from_arrays([pa.array(-1 - replies.column(0).to_numpy(), pa.int32()), replies.column(1)], names=["bucket", "blob"])


def _blobs(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])


def _parse(length: int, buckets: int):
    """Triggers of (id, mark, text) rows as blobs by bucket: documents' ids and marks, keys, and each key's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            doc, key, place = [], [], []
            for lo, _, data, offsets in tk.chunks(batch.column(2)):
                d, _, _, k = phrases(data, offsets, length)
                doc.append(d + lo)
                key.append(k)
                place.append(_ordinals(d))
            d, k, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, key, place))
            order = np.argsort(k, kind="stable")
            d, k, p = d[order], k[order].astype(np.uint64), p[order]
            if len(d):
                start, own = _starts(k), ids[d]
                least, most = (_over(start, len(d), f.reduceat(own, start)) for f in (np.minimum, np.maximum))
                between = (own > least) & (own < most)
                if between.any():
                    yield _passed(_replies(ids, marks, d[between], buckets, p[between]))
                    d, k, p = d[~between], k[~between], p[~between]
            found = []
            for b, part in _split(_buckets(k.astype(np.uint64), buckets)):
                part = part[np.argsort(k[part], kind="stable")]
                own, of = np.unique(d[part], return_inverse=True)
                high = k[part] >> np.uint64(16)  # 48 bits are enough to tell which triggers are worth a closer look
                found.append((b, _pack(ids[own], marks[own], np.diff(high, prepend=np.uint64(0)), of.astype(np.uint32), p[part].astype(np.uint32))))
            if found:
                yield _blobs(found)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, held = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append(blob)
    if held:
        yield now, held


def _ints(values: np.ndarray) -> bytes:
    """Numbers as bytes, four each where all fit, else eight; the last byte says which."""
    wide = bool(values.size) and int(values.max()) >= 1 << 32
    return values.astype("<i8" if wide else "<u4").tobytes() + bytes([wide])


def _of_ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8" if blob[-1] else "<u4", (len(blob) - 1) // (8 if blob[-1] else 4)).astype(np.int64)


def _replies(ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, buckets: int, *values: np.ndarray) -> pa.RecordBatch:
    """Values for documents as blobs by the bucket of the document."""
    found = []
    for b, part in _split((tk.mix(ids[doc].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)):
        part = part[np.argsort(doc[part], kind="stable")]
        own, of = np.unique(doc[part], return_inverse=True)
        found.append((b, _pack(ids[own], marks[own], of.astype(np.uint32), *(v[part].astype(np.int64) for v in values))))
    return _blobs(found)


def _gathered(n_values: int):
    """One row (id, mark, blob) for each document that has replies, the blob with all its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_bucket(batches):
            parts = [_unpack(blob, "<i8", "<i8", "<u4", *["<i8"] * n_values) for blob in blobs]
            i, m = (np.concatenate([p[c][p[2]] for p in parts]) for c in (0, 1))
            values = np.stack([np.concatenate([p[3 + c] for p in parts]) for c in range(n_values)])
            order = np.lexsort((values[0], m, i))
            i, m, values = i[order], m[order], values[:, order]
            start = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (m[1:] != m[:-1])]))
            ends = np.concatenate([start[1:], [len(i)]])
            for k in range(0, len(start), 4096):
                rows = [_ints(values[:, a:b]) for a, b in zip(start[k : k + 4096], ends[k : k + 4096])]
                yield pa.RecordBatch.from_arrays([pa.array(i[start[k : k + 4096]]), pa.array(m[start[k : k + 4096]]), pa.array(rows, pa.binary())], names=["id", "mark", "blob"])

    return run


def _shared(buckets: int):
    """Places of the triggers whose key more than one document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches):
            if b < 0:
                yield _blobs([(-1 - b, x) for x in blobs])
                continue
            i, m, d, p = _common(blobs)
            if len(d):
                yield _replies(i, m, d, buckets, p)

    return run


def _common(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    ids, marks, keys, docs, places, n = [], [], [], [], [], 0
    for blob in blobs:
        i, m, k, d, p = _unpack(blob, "<i8", "<i8", "<u8", "<u4", "<u4")
        ids.append(i)
        marks.append(m)
        keys.append(np.cumsum(k, dtype=np.uint64))
        docs.append(d.astype(np.int64) + n)
        places.append(p)
        n += len(i)
    i, m, k, d, p = (np.concatenate(x) for x in (ids, marks, keys, docs, places))
    order = np.argsort(k, kind="stable")
    k, d, p = k[order], d[order], p[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    of = i[d]
    many = np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start)
    keep = np.repeat(many, np.diff(np.concatenate([start, [len(k)]])))
    return i, m, d[keep], p[keep].astype(np.int64)


def _dictionary(length: int, buckets: int):
    """Phrases of the triggers that others have, as blobs by bucket: distinct phrases' bytes, and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            parts, texts = [], []
            for lo, hi, data, offsets in tk.chunks(batch.column(2)):
                d, first, last, k = phrases(data, offsets, length)
                base = np.searchsorted(d, np.arange(hi - lo))
                picked = [base[i] + _of_ints(wanted[lo + i].as_py()) for i in range(hi - lo)]
                pick = np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
                d, first, last, k = d[pick], first[pick], last[pick], k[pick]
                size = last - first + length
                whole = [tk.span_hash(tk.prefix_hash(data, x), first, first + size, x) for x in (0, 1)]
                parts.append((d + lo, first, first - offsets[d], size, k, *whole, np.full(len(d), len(texts))))
                texts.append(data)
            d, first, at, size, k, one, two, chunk = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 8
            if not len(d):
                continue
            order = np.lexsort((size, two, one))
            d, first, at, size, k, one, two, chunk = (x[order] for x in (d, first, at, size, k, one, two, chunk))
            start, own = _starts(one, two, size), ids[d]
            later = own > _over(start, len(d), np.minimum.reduceat(own, start))
            if later.any():
                yield _passed(_replies(ids, marks, d[later], buckets, at[later], at[later] + size[later]))
                d, first, at, size, k, one, two, chunk = (x[~later] for x in (d, first, at, size, k, one, two, chunk))
            start = _starts(one, two, size)
            entry = _over(start, len(d), np.arange(len(start)))
            found = []
            for b, part in _split(_buckets(k, buckets)):
                own_entries, of = np.unique(entry[part], return_inverse=True)
                docs, doc = np.unique(d[part], return_inverse=True)
                src = start[own_entries]
                text = np.concatenate([texts[chunk[j]][first[j] : first[j] + size[j]] for j in src])
                found.append((b, _pack(ids[docs], marks[docs], size[src].astype(np.uint32), (k[src] % np.uint64(SLICES)).astype(np.uint8), text, of.astype(np.uint32), doc.astype(np.uint32), at[part].astype(np.int64))))
            if found:
                yield _blobs(found)

    return run


def suffix_keys(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A number for each suffix of text that starts at `at`: in the order of the suffixes' first `length` bytes, equal where those are."""
    span = min(8, length)
    n = len(text) - span + 1
    key = np.zeros(n, np.uint64)
    for j in range(span):
        key = key << np.uint64(8) | text[j : j + n]
    while span < length:
        step = min(span, length - span)
        rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = rank[: len(rank) - step] << np.uint64(32) | rank[step:]
        span += step
    return key[at]


def _order(length: int, i, size, text_at, text, f, d, at):
    """Ranges (document, start, end) of one slice: f, d, at are occurrences, the others entries of the whole bucket."""
    used, f = np.unique(f, return_inverse=True)
    size = size[used]
    begin = np.cumsum(size) - size
    text = text[np.arange(size.sum()) + np.repeat(text_at[used] - begin, size)]
    # equal phrases of different blobs become one entry; two hashes of 64 bits and the size tell phrases apart
    whole = [tk.span_hash(tk.prefix_hash(text, x), begin, begin + size, x) for x in (0, 1)]
    order = np.lexsort((size, *whole))
    start = _starts(size[order], *(x[order] for x in whole))
    one, of = order[start], np.empty(len(size), np.int64)
    of[order] = _over(start, len(size), np.arange(len(start)))
    f, size, old = of[f], size[one], begin[one]
    begin = np.cumsum(size) - size
    text = text[np.arange(size.sum()) + np.repeat(old - begin, size)]
    own = i[d]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, f, own)
    # every suffix of every entry that has a whole window, in the order of their bytes
    count = size - length + 1
    at_window = np.cumsum(count) - count
    entry = np.repeat(np.arange(len(one)), count)
    shift = np.arange(count.sum()) - np.repeat(at_window, count)
    h = suffix_keys(text, begin[entry] + shift, length)
    array = np.argsort(h, kind="stable")  # the suffix array; equal keys: at least `length` bytes in common
    start = _starts(h[array])
    window = np.empty(len(h), np.int64)
    window[array] = _over(start, len(h), np.minimum.reduceat(least[entry[array]], start))
    top, bottom = np.maximum.reduceat(window, at_window), np.minimum.reduceat(window, at_window)
    full, some = own > top[f], (own <= top[f]) & (own > bottom[f])
    where, lo, hi = [d[full]], [at[full]], [at[full] + size[f[full]]]
    part = np.flatnonzero(some)
    if len(part):
        c = count[f[part]]
        occ = np.repeat(part, c)
        sh = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        hit = window[np.repeat(at_window[f[part]], c) + sh] < own[occ]
        occ, sh = occ[hit], sh[hit]
        if len(occ):
            new = np.flatnonzero(np.concatenate([[True], (occ[1:] != occ[:-1]) | (sh[1:] != sh[:-1] + 1)]))
            end = np.concatenate([new[1:], [len(occ)]]) - 1
            where.append(d[occ[new]])
            lo.append(at[occ[new]] + sh[new])
            hi.append(at[occ[new]] + sh[end] + length)
    return np.concatenate(where), np.concatenate(lo), np.concatenate(hi)


def _decide(length: int, buckets: int):
    """Byte ranges (start, end) of windows that a smaller document has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, blobs in _by_bucket(batches):
            if b < 0:
                yield _blobs([(-1 - b, x) for x in blobs])
                continue
            ids, marks, sizes, slices, texts, phrase, docs, starts, n, m = [], [], [], [], [], [], [], [], 0, 0
            while blobs:
                i, mk, s, sl, t, f, d, at = _unpack(blobs.pop(), "<i8", "<i8", "<u4", "<u1", "<u1", "<u4", "<u4", "<i8")
                for held, value in ((ids, i), (marks, mk), (sizes, s.astype(np.int64)), (slices, sl), (texts, t), (phrase, f.astype(np.int64) + m), (docs, d.astype(np.int64) + n), (starts, at)):
                    held.append(value)
                n, m = n + len(i), m + len(s)
            i, mk, size, sl, text, f, d, at = (np.concatenate(x) for x in (ids, marks, sizes, slices, texts, phrase, docs, starts))
            del texts
            text_at = np.cumsum(size) - size
            found = []
            for k in range(SLICES):
                pick = np.flatnonzero(sl[f] == k)
                if len(pick):
                    found.append(_order(length, i, size, text_at, text, f[pick], d[pick], at[pick]))
            where, lo, hi = (np.concatenate(x) for x in zip(*found))
            if len(where):
                yield _replies(i, mk, where, buckets, lo, hi)

    return run


def merged(blob: bytes | None) -> np.ndarray:
    """Disjoint ranges (start, end), ascending, that cover what the blob covers; ranges that touch become one."""
    both = _of_ints(blob).reshape(2, -1) if blob else np.zeros((2, 0), np.int64)
    if not both.size:
        return np.zeros((0, 2), np.int64)
    both = both[:, np.argsort(both[0], kind="stable")]
    reach = np.maximum.accumulate(both[1])
    new = np.flatnonzero(np.concatenate([[True], both[0, 1:] > reach[:-1]]))
    return np.stack([both[0, new], reach[np.concatenate([new[1:], [both.shape[1]]]) - 1]], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, _, _ in tk.chunks(batch.column(1), 1 << 23):
            out: list[tuple] = []
            for text, blob in zip(batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)):
                data = (text.as_py() or "").encode()
                spans = merged(blob.as_py())
                digest, at = hashlib.sha256(), 0
                for a, b in spans.tolist():
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                out.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), digest.hexdigest(), spans.ravel().tolist()))
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans) of every document.

    Each byte covered by a string of `length` bytes that also starts in a document with a smaller id is removed; spans
    holds the removed ranges (start, end, start, end ...). Null texts are empty. Rows with the same id do not count as
    smaller than each other; a row with a null id loses nothing and removes nothing. Other columns are ignored.
    """
    value = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(value).alias("mark"), value.alias("text"))
    texts = rows.where("id is not null")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    # of equal texts the first one speaks for all: the others are repeats as a whole
    copies = texts.groupBy("mark", F.md5("text").alias("sum"), F.octet_length("text").alias("n")).agg(F.min("id").alias("id")).select("id", "mark").distinct()
    part, reply = "bucket int, blob binary", "id long, mark long, blob binary"

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    triggers = dealt(texts.join(copies, ["id", "mark"]).select("id", "mark", "text").mapInArrow(_parse(length, buckets), part))
    asked = dealt(triggers.mapInArrow(_shared(buckets), part)).mapInArrow(_gathered(1), reply)
    entries = dealt(texts.join(asked, ["id", "mark"]).select("id", "mark", "text", "blob").mapInArrow(_dictionary(length, buckets), part))
    ranges = dealt(entries.mapInArrow(_decide(length, buckets), part)).mapInArrow(_gathered(2), reply)
    answers = copies.withColumn("first", F.lit(True)).join(ranges, ["id", "mark"], "left")
    final = texts.join(answers, ["id", "mark"], "left")
    n = F.octet_length("text")
    everything = F.concat(_little(F.lit(0)), _little(n), F.unhex(F.lit("01")))
    final = final.select("id", "text", F.when(F.col("first"), F.col("blob")).when(n >= length, everything).alias("blob"))
    final = final.unionByName(rows.where("id is null").select("id", "text", F.lit(None).cast("binary").alias("blob")))
    out = final.mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.withColumnRenamed("id", id_col)


def _little(x: Column) -> Column:
    """A number under 2^31 as eight bytes, the lowest first."""
    big = F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))
    return F.concat(*[F.substring(big, i, 1) for i in range(8, 0, -1)])
