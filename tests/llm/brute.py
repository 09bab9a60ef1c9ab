"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(docs, width, num, den):
    """{doc_id: (set size, component)} of [(doc_id, text)]."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def windows_removed(docs, window):
    """{doc_id: (words, removed, digest)}."""
    first = {}
    for i, text in sorted(docs):
        w = words(text)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {p for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for p in range(j, j + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def luhn(digits):
    return sum(c if k % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c) for k, c in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    """[(kind, start, end)] of the base patterns."""
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    kinds = ["email", "ip", "card", "phone"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {p for j in range(len(w) - 4) if counts[tuple(w[j : j + 5])] > 1 for p in range(j, j + 5)}
    n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
    return (*n, len(w) < 10 or 100 * len(covered) > 20 * len(w))


def contaminated(docs, items, window):
    """{doc_id: (words, hit, items)}."""
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = collections.defaultdict(set)
    for name, text in items:
        w = norm(text)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[j : j + n])].add(str(name))
    out = {}
    for i, text in docs:
        w, hit, names = norm(text), set(), set()
        for n in {len(k) for k in wins}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in wins:
                    hit.update(range(j, j + n))
                    names |= wins[k]
        out[i] = (len(w), len(hit), sorted(names))
    return out


def line_removals(docs, block_words, blocks):
    """{doc_id: places of lines that go}, by aligning every document with every earlier one, and by runs of lines that an earlier one has."""
    held = {i: [tuple(words(x)) for x in (text or "").split("\n")] for i, text in docs}
    out = {}
    for i, mine in held.items():
        gone = set()
        full = [k for k, x in enumerate(mine) if x]
        for j in sorted(held):
            if j >= i:
                continue
            theirs = [x for x in held[j] if x]
            runs = {tuple(theirs[a:b]) for a in range(len(theirs)) for b in range(a + 1, len(theirs) + 1)}
            for a in range(len(full)):
                for b in range(a + 1, len(full) + 1):
                    run = tuple(mine[k] for k in full[a:b])
                    if sum(map(len, run)) >= block_words and run in runs:
                        gone.update(range(full[a], full[b - 1] + 1))
            names = {}
            number = lambda x: [names.setdefault(y, len(names)) for y in x]
            gone.update(blocks(number(held[j]), number(mine), [len(x) for x in mine], block_words))
        out[i] = {k for k in gone if mine[k]}
    return out


def disclosing(texts, around=20, min_contexts=3, min_length=4, threshold=0.8):
    """{text: terms that disclose an entity of it}, over the distinct texts."""
    import math

    texts = sorted(set(texts))
    contexts, holders, found, counts = (collections.defaultdict(set) for _ in range(4))
    for t in texts:
        for kind, a, b in personal(t):
            e = kind, t[a:b]
            contexts[e].add((t[max(0, a - around) : a], t[b : b + around]))
            holders[e].add(t)
            found[t].add((e, t[max(0, a - around) : a], t[b : b + around]))
        for w in words(t):
            if len(w) >= min_length:
                counts[w].add(t)
    kept = {e for e in contexts if len(contexts[e]) >= min_contexts}
    n = max(2, len(texts))
    flagged = collections.defaultdict(set)
    for e in kept:
        for w in {w for t in holders[e] for w in words(t) if len(w) >= min_length}:
            both = holders[e] & counts[w]
            seen = {(x, y) for t in both for f, x, y in found[t] if f == e}
            if len(seen) >= min_contexts and 1 + math.log(len(both) / len(counts[w])) / math.log(n / min(len(holders[e]), n - 1)) >= threshold:
                flagged[e].add(w)
    return {t: {w for e, _, _ in found[t] for w in flagged[e] if t in counts[w]} for t in texts}
