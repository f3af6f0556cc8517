"""Small frames and brute-force versions for the corpus operators."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra: bool = False):
    """Rows (doc_id, text[, lang[, source]]); ``extra`` adds columns whose names operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] else 0) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("k", "fp", "spans", "kept_row", "score", "lang_pred", "rank", "size", "block", "draws", "component_id"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def simhash(text: str | None) -> int:
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    if not words:
        return 0
    shingles = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64(b" ".join(s), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def repeats(texts: list[str | None], span: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by counting every string of span bytes."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for p in range(len(d) - span + 1):
            seen[d[p : p + span]] = seen.get(d[p : p + span], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - span + 1):
            if seen[d[p : p + span]] > 1:
                gone[p : p + span] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(c for c, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
