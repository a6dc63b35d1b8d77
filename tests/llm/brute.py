"""Plain Python versions of the operators, for small tables."""

import base64
import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def folded(text):
    return FOLDED.findall((text or "").translate(LOWER))


def base_counts(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def base_licenses(text):
    w = folded(text)
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def license_labels(text):
    """(labels, score), with the values and names of the operator's tables."""
    from mnemoscope.llm import license_scan as ls

    text, found, scores = text or "", set(), []
    w = folded(text)
    for phrase, label in (ls.BASE_PHRASES | ls.NOTICE_PHRASES).items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            found.add(label)
            scores.append(ls.VALUES[label])
    lower = text.translate(LOWER)
    for m in re.finditer("|".join(map(re.escape, ls.TAGS)), lower):
        labels, score = _expression(re.findall(r"[()]|[a-z0-9][a-z0-9.+-]*", lower[m.end() :].split("\n")[0]))
        if labels:
            found |= labels
            scores.append(score)
    return ",".join(sorted(found)), min(scores, default=0.0)


def _expression(tokens):
    from mnemoscope.llm import license_scan as ls

    labels, at, depth = set(), 0, 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def atom():
        nonlocal at, depth
        t = peek()
        if t in (None, ")", "and", "or", "with"):
            raise ValueError
        at += 1
        if t == "(":
            depth += 1
            v = either()
            if peek() != ")":
                raise ValueError
            at += 1
            depth -= 1
            return v
        label = ls.identifier_label(t)
        labels.update({label} - {None})
        return ls.VALUES.get(label, 0.0)

    def excepted():
        nonlocal at
        v = atom()
        while peek() == "with":
            at += 1
            if peek() == "(":
                atom()
            elif peek() in (None, ")", "and", "or", "with"):
                raise ValueError
            else:
                at += 1
            v = v + (1 - v) / 2 if v else 0.0
        return v

    def both():
        nonlocal at
        v = excepted()
        while peek() == "and":
            at += 1
            v = min(v, excepted())
        return v

    def either():
        nonlocal at
        v = both()
        while peek() == "or":
            at += 1
            v = max(v, both())
        return v

    try:
        return labels, either()
    except ValueError:
        return labels, min((ls.VALUES[x] for x in labels), default=0.0)


def warc_rows(rows):
    """rows: (page_id, html)."""
    top = {}
    for page, html in rows:
        d = hashlib.sha1((html or "").encode()).digest()
        top[d] = max((x for x in (top.get(d), page) if x is not None), default=None)
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        d = hashlib.sha1(payload).digest()
        same = page == top[d]
        out.append((page, len(payload), base64.b32encode(d).decode(), "response" if same else "revisit", None if same else top[d]))
    return sorted(out, key=repr)


_any = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
ASSIGN = re.compile(rf"""({'|'.join(map(_any, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    rank = {"assign": 0, "access": 1, "hex": 2}
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], rank[x[0]])))
    count = collections.Counter(k for k, _, _ in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(spans.encode()).hexdigest()


def mixed(rows, epochs=3):
    """rows: (doc_id, text, source); (doc_id, size, source_size, target, taken) of each."""
    key = lambda s: (s is None, s or "")
    docs = [(i, s, len(words(t))) for i, t, s in rows]
    name = ["null:" + hashlib.md5((t or "").encode()).hexdigest() if i is None else str(i) for i, t, _ in rows]
    size = collections.Counter()
    for _, s, n in docs:
        size[s] += n
    total, weight = sum(size.values()), {s: float(k % 3 + 1) for k, s in enumerate(sorted(size, key=key))}
    capped, level = set(), 0.0
    while len(capped) < len(size):
        free = [s for s in size if s not in capped]
        level = (total - sum(float(epochs) * size[s] for s in capped)) / sum(weight[s] for s in free)
        new = [s for s in free if level * weight[s] > epochs * size[s]]
        if not new:
            break
        capped.update(new)
    target = {s: float(epochs * size[s]) if s in capped else level * weight[s] for s in size}
    queue = []
    for s in size:
        upto = 0
        own = [(hashlib.md5(name[k].encode()).hexdigest(), i if i is not None else -1, n, k) for k, (i, x, n) in enumerate(docs) if x == s]
        for _, _, n, k in sorted(own):
            upto += n
            queue += [((e * size[s] + upto) / target[s], key(s), k, n) for e in range(epochs) if n]
    run, taken = 0, collections.Counter()
    for _, _, k, n in sorted(queue):
        run += n
        if run > total:
            break
        taken[k] += n
    return sorted(((i, n, size[s], round(target[s], 6), taken[k]) for k, (i, s, n) in enumerate(docs)), key=repr)


def without_repeats(rows, width=35):
    count, texts = collections.Counter(), [(i, words(t)) for i, t in rows]
    for _, w in texts:
        count.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if count[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def shingles(text, n=5):
    w = folded(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near_classes(rows, threshold=0.8):
    """The least id of each row's class, by plain Jaccard of all pairs; ids are not null."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    sets = [(i, t or "", shingles(t)) for i, t in rows]
    for k, (i, t, s) in enumerate(sets):
        for j, u, v in sets[:k]:
            if t == u or (s or v) and len(s & v) >= threshold * len(s | v):
                join(i, j)
    return {i: find(i) for i in parent}


def weighted_pairs(rows, n=5):
    """{(i, j): (weighted, plain similarity)} of all pairs of different texts that share a run of n words, with exact document frequencies."""
    import math

    grams = {}
    for i, t in rows:
        w = folded(t)
        grams[i] = collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or collections.Counter([tuple(w)] if w else [])
    df = collections.Counter(g for c in grams.values() for g in c)
    docs = sum(1 for c in grams.values() if c)
    idf = {g: 1 + math.log((1 + docs) / (1 + k)) / math.log(1 + docs) for g, k in df.items()}
    weight = {i: {g: (1 + math.log(k)) * idf[g] for g, k in c.items()} for i, c in grams.items()}
    total, holders, low, common = {i: sum(w.values()) for i, w in weight.items()}, collections.defaultdict(list), collections.Counter(), collections.Counter()
    for i, w in weight.items():
        for g in w:
            for j in holders[g]:
                low[j, i] += min(w[g], weight[j][g])
                common[j, i] += 1
            holders[g].append(i)
    return {(j, i): (s / (total[i] + total[j] - s), common[j, i] / (len(weight[i]) + len(weight[j]) - common[j, i])) for (j, i), s in low.items()}


def leaks(docs, items, threshold=0.8, least=1):
    out = []
    for item, text in items:
        w = folded(text)
        own = shingles(text) if len(w) >= 5 else set()
        for doc, body in docs:
            words = folded(body)
            if own:
                found = len(own & shingles(body)) if len(words) >= 5 else 0
                if found >= threshold * len(own):
                    out.append((doc, item, len(own), found))
            elif len(w) >= least and w and any(words[k : k + len(w)] == w for k in range(len(words) - len(w) + 1)):
                out.append((doc, item, 1, 1))
    return sorted(out, key=repr)
