"""Small tables with every awkward case, and the operators' results on them by brute force."""

import hashlib
import zlib

import numpy as np
import xxhash

SENTENCE = "The quick brown fox jumps over the lazy dog while seven small ships sail past the old harbour wall at dawn today"
LONG = " ".join(f"w{i % 4001}x{i % 37}" for i in range(60_000))

ROWS = [
    # doc_id, text, lang, source, n_chars
    (1, SENTENCE + " and then some", "en", "a", 1), (2, SENTENCE, "en", "a", 2), (3, SENTENCE, None, "b", 3), (3, SENTENCE, None, "b", 3),
    (4, None, "en", "b", None), (5, "", "en", None, 0), (6, " \t\n ", "en", None, 4), (7, "one", "en", "c", 3), (8, "One", "en", "c", 3),
    (9, LONG, "en", "a", len(LONG)), (10, LONG + " end", "en", None, 7), (None, "no id here at all", "en", "b", 1),
    (None, SENTENCE, "en", "a", 1), (None, "no id here at all", "en", "b", 1), (11, "Ünï çödé ß 漢字  double space <|endoftext|> x", "de", "c", 9),
    (12, " leading and trailing ", "en", "c", 5), (13, "same id", "en", "a", 1), (13, "other text of the same id", "en", "a", 1),
    (14, "a a a a b b a a a a a a a a a a a a a a a a a a a a a a a a a a a b", "en", "b", 1), (-5, "negative id", "en", "b", 2),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "fp long, doc int, copy string, symbol string, _size string, token long, piece string, size int, toxic string, path int, start string, _copy int, _fp string, _keep int, _id string, _path int, _text_hash int, _secrets int, other_0 string"


def documents(spark, rows=ROWS):
    """The rows with extra columns whose names the operators use themselves."""
    import pyspark.sql.functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for field in CLASHES.split(", "):
        name, kind = field.split()
        df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    return [w for w in data.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]


def simhash(text):
    w = words(text, lower=True)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints, ids):
    """component id of each row, by comparing all pairs."""
    n, parent = len(fingerprints), list(range(len(fingerprints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = []
    for i in range(n):
        found = [ids[j] for j in range(n) if root(j) == root(i) and ids[j] is not None]
        out.append(min(found) if found else None)
    return out


def removal(rows, window=20):
    """{(doc_id, text): (n_words, n_removed, sha256)} for (doc_id, text) rows without ids' ties."""
    first = {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (doc, text, i))
    out = {}
    for doc, text in order:
        w = words(text)
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (doc, text, i):
                gone[i:i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc, text] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def is_held_out(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2
