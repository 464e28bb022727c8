"""Small tables with the awkward cases, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tkey string, spans int, queue string, x string"


def rows(texts: list[str | None], ids: list[int | None] | None = None, lang=None, source=None) -> list[tuple]:
    """Rows of DOC_SCHEMA; the columns from ``tkey`` on clash with names the operators use inside."""
    ids = ids if ids is not None else list(range(len(texts)))
    return [(i, t, lang[k] if lang else "en", source[k] if source else "s", None if t is None else len(t), "clash", 7, "q", None)
            for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


def frame(spark, texts, ids=None, **columns):
    return spark.createDataFrame(rows(texts, ids, **columns), DOC_SCHEMA)


def awkward(rng: random.Random) -> tuple[list[str | None], list[int | None]]:
    """Texts with nulls, empties, copies, near copies, shared passages and lines, a long text; ids with repeats and a null."""
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(120)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage, line = words(40), words(14)
    texts: list[str | None] = [None, "", " \t\n ", "one", words(12), words(13)]
    texts += [words(rng.randint(1, 60)) for _ in range(20)]
    texts += [f"{words(9)} {passage}\n{words(7)}" for _ in range(8)]
    texts += [f"{words(9)}\n  {line.upper()}\t\n{line}\n\n{words(3)}" for _ in range(7)]
    copy = words(50)
    texts += [copy] * 5 + [copy.replace(" ", " ", 1), copy + " tail", copy.replace(" ", "\t\n", 3), copy.upper()]
    texts += ["ha " * 400, "ha " * 300 + words(30), words(4000) + "\n" + line]
    ids: list[int | None] = list(range(len(texts)))
    rng.shuffle(ids)
    texts += [texts[30], texts[31], passage, passage]  # repeated rows, one id with two texts, no id
    ids += [ids[30], ids[2], None, None]
    return texts, ids


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(texts, ids, k=13):
    first: dict[tuple, int] = {}
    split = [WORD.findall(t or "") for t in texts]
    for w, i in zip(split, ids, strict=True):
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j:j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for w, i in zip(split, ids, strict=True):
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - k + 1):
                if first[tuple(w[j:j + k])] < i:
                    gone[j:j + k] = [True] * k
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def _key(line: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def line_dedup(texts, ids, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for t, i in zip(texts, ids, strict=True):
        if i is not None:
            for x in (t or "").split("\n"):
                held[_key(x)].add(i)
    out = []
    for t, i in zip(texts, ids, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(_key(x)) < min_chars or len(held[_key(x)]) < min_docs or max(held[_key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def contamination(texts, ids, items: list[tuple[int, str | None]], k=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lowered(text))
        n = min(k, len(w))
        for j in range(len(w) - n + 1):
            if n:
                windows[tuple(w[j:j + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for t, i in zip(texts, ids, strict=True):
        w = ITEM_WORD.findall(lowered(t))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                of = windows.get(tuple(w[j:j + n]))
                if of:
                    hit[j:j + n] = [True] * n
                    found |= of
        named = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(named), sha(",".join(named)), any(hit)))
    return out


def fingerprint(text: str | None, width=3) -> int:
    w = WORD.findall(lowered(text))
    shingles = [" ".join(w[j:j + width]) for j in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], ids: list, bits=3) -> list:
    """Smallest id reachable over links of at most ``bits``, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                root[find(a)] = find(b)
    least: dict = {}
    for a, i in enumerate(ids):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [least.get(find(a)) for a in range(len(prints))]


ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in spans)


def language_profiles(labelled: list[tuple[str, str]], size: int) -> dict[str, list[str]]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in labelled:
        counts[lang].update(ngrams(text))
    return {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], _code(x[0])))[:size]] for lang, c in counts.items()}


def _code(gram: str) -> int:
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ngrams(text: str) -> Counter:
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    if not t.strip():
        return Counter()
    return Counter(c for c in t if c != " ") + Counter(t[i:i + 2] for i in range(len(t) - 1)) + Counter(t[i:i + 3] for i in range(len(t) - 2))


def language(text: str | None, profiles: dict[str, list[str]], size: int) -> tuple[str, float]:
    own = [g for g, _ in sorted(ngrams(text or "").items(), key=lambda x: (-x[1], _code(x[0])))[:size]]
    if not own or not profiles:
        return "und", 0.0
    apart = {}
    for lang, ranked in profiles.items():
        place = {g: r for r, g in enumerate(ranked)}
        apart[lang] = sum(abs(r - place[g]) if g in place else size for r, g in enumerate(own))
    best = min(sorted(apart), key=lambda x: apart[x])
    return best, 1 - apart[best] / (len(own) * size)
