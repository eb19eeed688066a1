"""Plain restatements that the operators are held against."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text: str | None, k: int) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def jaccard_components(rows: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t, k) for _, t in rows]
    posted = defaultdict(list)
    shared: dict[tuple, int] = defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            for j in posted[x]:
                shared[j, i] += 1
            posted[x].append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for (i, j), n in shared.items():
        if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def suffix_dedup(rows: list[tuple], span: int = 200) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows."""
    import hashlib
    from collections import Counter

    data = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(b[i : i + span] for _, b in data for i in range(len(b) - span + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        last = 0
        for i in range(len(b) - span + 1):
            if times[b[i : i + span]] > 1:
                for x in range(max(i, last), i + span):
                    gone[x] = 1
                last = i + span
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(text: str | None, most: dict[int, float], most_lines: float, most_symbols: float) -> dict:
    """The measures and the verdict of the quality rules."""
    text = text or ""
    words = WORD.findall(text)

    def inside(k: int) -> list[bool]:
        runs = defaultdict(list)
        for i in range(len(words) - k + 1):
            runs[tuple(words[i : i + k])].append(i)
        out = [False] * len(words)
        for at in runs.values():
            for i in at if len(at) > 1 else ():
                out[i : i + k] = [True] * k
        return out

    seen, dup, times = set(), 0, defaultdict(int)
    lines = text.split("\n")
    for line in lines:
        times[line] += 1
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": sum(inside(3))}
    out["base_failed"] = out["n_words"] < 50 or 100 * out["n_repeat_words"] > 50 * out["n_words"]
    share = {k: sum(len(w) for w, x in zip(words, inside(k)) if x) / max(chars, 1) for k in most}
    line_share = sum(len(w) for line in lines if times[line] > 1 for w in WORD.findall(line)) / max(chars, 1)
    shares = {"line_share": line_share} | {f"share_{k}": x for k, x in share.items()}
    out["kept"] = not (out["base_failed"] or line_share > most_lines or out["n_symbols"] > most_symbols * len(words) or any(share[k] > m for k, m in most.items()))
    return out | shares


KINDS = ("assign", "access", "hex", "entropy")


def is_allowed(s: str) -> bool:
    if re.fullmatch(r"[0-9+/_=-]*", s) or re.fullmatch(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", s):
        return True
    plain = re.sub(r"[/_=-]?[0-9]{1,8}$", "", s, count=1)
    if not re.fullmatch(r"[A-Za-z+/_=-]*", plain):
        return False
    # a run of letters in one case, or of small letters and then capitalised words of three letters or more
    for run in re.findall(r"[A-Za-z]+", plain):
        if not run.isupper():
            humps = [len(h) for h in re.findall(r"[A-Z][a-z]*", run)]
            if any(h < 3 for h in humps):
                return False
    return True


def secret_spans(text: str | None, classes: dict, window: int) -> tuple[list, list]:
    """Base spans and all spans as (start, kind, end)."""
    import math

    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    left = list(text)
    for a, _, b in base:
        left[a:b] = " " * (b - a)

    def entropy(s: str, symbols: str) -> float:
        s = [c for c in s if c in symbols]
        best = 0.0
        for i in range(len(s) - window + 1):
            counts = defaultdict(int)
            for c in s[i : i + window]:
                counts[c] += 1
            best = max(best, -sum(n / window * math.log2(n / window) for n in counts.values()))
        return best

    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", "".join(left)):
        word = re.sub(r"example|placeholder|changeme|xxxxxx", "", m[0], flags=re.IGNORECASE)
        if not word or is_allowed(word):
            continue
        _, symbols, least = next(c for c in classes.values() if re.search(c[0], word))
        if entropy(word.lower() if "A" not in symbols else word, symbols) >= least - 1e-9:
            more.append((m.start(), 3, m.end()))
    return sorted(base), sorted(base + more)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
