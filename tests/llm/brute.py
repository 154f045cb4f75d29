"""Plain Python versions of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text)).encode()).hexdigest()


def crc(ids):
    import numpy as np
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def token_ids(tokenizer_path, text, end=2):
    from tokenizers import Tokenizer
    t = _TOK.get(tokenizer_path)
    if t is None:
        t = _TOK[tokenizer_path] = Tokenizer.from_file(tokenizer_path)
    return t.encode(text or "", add_special_tokens=False).ids + [end]


_TOK = {}
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def components(rows):
    """{id: component} for (id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for g in s:
            by[g].append(at)
    for at, (i, s) in enumerate(sets):
        seen = defaultdict(int)
        for g in s:
            for b in by[g]:
                if b < at:
                    seen[b] += 1
        for b, n in seen.items():
            if 100 * n >= 75 * (len(s) + len(sets[b][1]) - n):
                x, y = find(i), find(sets[b][0])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def line_words(line):
    return frozenset(w for w in re.split("[ \t\r]", line.lower()) if w)


def dedup_lines(rows, num=75, den=100):
    """[(id, text, removed line numbers)] for (id, text) rows of distinct ids."""
    lines = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate([] if t is None else t.split("\n")):
            if line_words(line):
                lines.append((i, k, line_words(line)))
    seen, by, gone = [], defaultdict(list), defaultdict(list)
    for i, k, s in lines:
        count = defaultdict(int)
        for w in s:
            for j in by[w]:
                count[j] += 1
        if any(den * c >= num * (len(s) + len(seen[j]) - c) for j, c in count.items()):
            gone[i].append(k)
        if s not in by_set(by):
            for w in s:
                by[w].append(len(seen))
            seen.append(s)
            by["__sets"].add(s)
    out = []
    for i, t in rows:
        keep = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[i]))
        out.append((i, keep, gone[i]))
    return out


def by_set(by):
    if "__sets" not in by:
        by["__sets"] = set()
    return by["__sets"]


def top_k(vectors, is_query, k):
    """[(query, rank, id, score)] of integer vectors {id: list}."""
    out = []
    for q in vectors:
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def plain_words(text):
    table = {c: " " for c in range(128) if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER).translate(table))


def tiling(doc, item, least):
    """Covered words of the item by greedy string tiling, the textbook way."""
    dm, im = [False] * len(doc), [False] * len(item)
    covered = 0
    while True:
        best, where = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while (i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]
                       and not dm[i + k] and not im[j + k]):
                    k += 1
                if k > best:
                    best, where = k, [(i, j)]
                elif k == best and k >= least:
                    where.append((i, j))
        if not where:
            return covered
        for i, j in where:
            if not any(dm[i:i + best]) and not any(im[j:j + best]):
                dm[i:i + best] = [True] * best
                im[j:j + best] = [True] * best
                covered += best
