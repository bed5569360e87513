"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passages(rows, width=13):
    """[(id, text)] -> [(id, n_words, n_removed, digest)]"""
    first = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                keep[k : k + width] = [False] * width
        kept = [x for x, y in zip(w, keep, strict=True) if y]
        out.append((i, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def line_key(line):
    return line.strip(SPACE).translate(LOWER)


def without_lines(rows, min_chars=40, min_docs=5):
    """[(id, text)] -> [(id, n_lines, n_dropped, kept text)]"""
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(line_key(line)) >= min_chars:
                holders.setdefault(line_key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(line_key(x), ())) < min_docs or i == max(holders[line_key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """[(id, text)] -> [(id, n_shingles, component, kept)]"""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return [(i, len(shingles(t)), None if i is None else top(i), i is None or top(i) == i) for i, t in rows]


def copies(rows):
    """[(id, text)] -> [(id, keep_id, size, digest)]"""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[norm]), sha(norm)))
    return out


def base_secrets(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    return [sum(k == n for _, k, _ in found) for n in range(3)], ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)


def top_scores(rows, every=50, k=5):
    """[(id, vector)] -> [(query, rank, id, score)]"""
    import math

    use = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in use:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in use if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def line_values(text):
    """The features of each line of a text, by name."""
    lines = text.encode().split(b"\n")
    split = [[w for w in re.split(rb"[\x20\x09-\x0D]+", line) if w] for line in lines]
    lower = [[w.lower() for w in ws] for ws in split]
    symbols = set(b"!\"#$%&'()*+-/<=>@[\\]^_`{|}~")
    every = [w for ws in lower for w in ws]
    repeats = 1 - len(set(every)) / max(len(every), 1)
    out = []
    for line, ws, ls in zip(lines, split, lower, strict=True):
        chars = len(line.decode())
        some, each = max(chars, 1), max(len(ws), 1)
        letters = sum(chr(b).isascii() and chr(b).isalpha() or b >= 192 for b in line)
        sizes = [len(w) for w in ws]
        mean = sum(sizes) / each
        spread = math.sqrt(max(sum(s * s for s in sizes) / each - mean**2, 0))
        out.append({
            "length": math.log1p(chars), "upper": sum(65 <= b <= 90 for b in line) / max(letters, 1), "digit": sum(48 <= b <= 57 for b in line) / some, "stops": sum(b in b".,;:?" for b in line) / some,
            "symbols": sum(b in symbols for b in line) / some, "foreign": sum(b >= 192 for b in line) / some, "word_length": min(mean, 40) / 10, "word_spread": min(spread, 40) / 10,
            "adjacent_repeats": sum(a == b for a, b in zip(ls, ls[1:], strict=False)) / each, "distinct": len(set(ls)) / each, "symbol_ends": sum(w[-1] in symbols for w in ws) / each,
            "repeated_line": float(bool(ls) and lower.count(ls) > 1), "capital_start": float(line[:1].isupper() and line[:1].isascii()), "full_stop_end": float(line.endswith(b".")), "document_repeats": repeats,
            "empty": float(not ws), "bangs": line.count(b"!") / some, "letters_in_word": letters / max(sum(sizes), 1), "markup": sum(b in b"<>{}[]|=/\\" for b in line) / some,
        })
    return out, [max(len(line.decode()), 1) for line in lines]


def quality_score(text, model):
    """Marginals of a chain by forward and backward sums, one line after the other, weighted by length."""
    from braidwork.llm.quality import FEATURES, NEIGHBOURS

    values, weights = line_values(text)
    own = []
    for k, v in enumerate(values):
        x = [v[name] for name in FEATURES]
        for name in NEIGHBOURS:
            x += [values[k - 1][name] if k else 0.0, values[k + 1][name] if k + 1 < len(values) else 0.0]
        x.append(1.0)
        z = [max(-8.0, min(8.0, (a - m) / s)) for a, m, s in zip(x, model.mean.tolist(), model.scale.tolist(), strict=True)]
        own.append(sum(a * b for a, b in zip(z, model.weights.tolist(), strict=True)))
    steps = model.steps.tolist()

    def passed(scores, weight):
        """Normalised sums over the chains up to each line."""
        out = []
        for s in scores:
            before = out[-1] if out else None
            now = [sum(before[a] * math.exp(weight(a, b)) for a in (0, 1)) if before else 1.0 for b in (0, 1)]
            now[1] *= math.exp(max(-700.0, min(700.0, s)))
            total = sum(now)
            out.append([now[0] / total, now[1] / total])
        return out

    forward = passed(own, lambda a, b: steps[a][b])
    backward = passed(own[::-1], lambda a, b: steps[b][a])[::-1]
    total = 0.0
    for s, f, b, w in zip(own, forward, backward, weights, strict=True):
        good, bad = f[1] * b[1] / math.exp(max(-700.0, min(700.0, s))), f[0] * b[0]
        total += w * good / (good + bad)
    return total / sum(weights)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ngrams(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def importance(rows, target, percent=5, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank)"""
    def counted(texts):
        out = [0] * buckets
        for t in texts:
            for f in ngrams(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counted(x for _, x in rows), counted(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        n, found = ngrams(x)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, least=3, most=200):
    """[(lang, source, text)] -> [(lang, source, part, item, value, rank)]"""
    out = []
    rows = [tuple(x or "" for x in r) for r in rows]
    for lang in {r[0] for r in rows}:
        docs = [(s, LETTERS.findall(t.translate(LOWER))) for own, s, t in rows if own == lang]
        seen = Counter(w for _, words in docs for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= least)
        groups = {s: Counter() for s, _ in docs}
        for s, words in docs:
            groups[s].update(w for w in words if seen[w] >= least)
        whole = sum(groups.values(), Counter())

        def shares(count, kept=kept):
            total = sum(count.values())
            return {w: 1 + 1_000_000_000 * (count[w] + 1) // (total + len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        for s in groups:
            found = {"pair": [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in groups if o != s]}
            found["term"] = [((p[s][w] - q[w]) ** 2 // q[w], w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, items in found.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < most]
    return out
