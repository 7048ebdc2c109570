"""Plain-Python versions of what the fixed contracts ask for, written for clarity alone."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    return text.translate(UPPER)


def rule_counts(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def license_base(text: str | None) -> dict:
    words = ALNUM.findall(lower(text or ""))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min((i for i, _ in places), default=None),
        "last_word": max((i for i, _ in places), default=None),
        "base_labels": ",".join(sorted({x for _, x in places})),
    }


def url_facts(url: str | None) -> dict:
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return {"host": host, "path": path, "rule": best and best[1] + best[2], "rule_verdict": best and best[0]}


def shingles(text: str | None, size: int = 5) -> set:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def similar(a: set, b: set, percent: int = 80) -> bool:
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def components(sets: dict[int, set]) -> dict[int, int]:
    """Smallest id reachable by links, by comparing everything with everything."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if root(i) != root(j) and similar(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def template(text: str) -> list[tuple[str, str]]:
    """(word, kind) of each token; kind is empty, or number, unit or name. Later parts of decimals and dates are left out."""
    from leafmill.llm.decontam import NUMBER_WORDS, UNIT_WORDS

    out, end, before = [], 0, False
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        word, between = m[0], text[end : m.start()]
        digits = bool(re.fullmatch("[0-9]+", word))
        part = digits and before and len(between) == 1 and between in ".,:/"
        name = word[0].isupper() and ord(word[0]) < 0x530 and end > 0 and not re.search("[.!?:\n]", between)
        end, before = m.end(), digits
        word = lower(word)
        kind = "number" if digits or word in NUMBER_WORDS else "unit" if word in UNIT_WORDS else "name" if name else ""
        if not part:
            out.append((word, kind))
    return out


def leaks(item: str, text: str, size: int = 8) -> bool:
    """Whether aligned windows whose slots agree cover half of the item's words."""
    a, b = template(item), template(text)
    n = size if len(a) >= 2 * size else len(a) // 2 if len(a) >= size else len(a)
    if not n:
        return False
    most = n - 4 if n == size else n - -(-n * 4 // size)
    shifts: dict[int, set] = {}
    for p in range(len(a) - n + 1):
        for q in range(len(b) - n + 1):
            x, y = a[p : p + n], b[q : q + n]
            typed = sum(k != "" for _, k in x)
            alike = [v or w for w, v in x] == [v or w for w, v in y] and 0 < typed <= most and typed == sum(k != "" for _, k in y)
            if [w for w, _ in x] == [w for w, _ in y] or alike:
                shifts.setdefault(q - p, set()).add(p)
    covered = set()
    for shift, places in shifts.items():
        meant: dict = {}
        agree = True
        for p in places:
            for k in range(p, p + n):
                if a[k][1] and b[k + shift][1]:
                    agree &= meant.setdefault(a[k], b[k + shift]) == b[k + shift]
        if agree:
            covered |= {k for p in places for k in range(p, p + n)}
    return bool(covered) and 100 * len(covered) >= 50 * len(a)


def suppressed(found: list) -> list:
    """(first, after, label) of detections that lie in none of higher priority, or of equal priority that is longer or, if as long, named before."""
    out = []
    for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in out):
            out.append(d)
    return [(a, b, r.label) for a, b, r in sorted(out, key=lambda d: (d[0], d[1], d[2].label))]


def license_spans(words: list[str], compiled) -> list:
    """Detections of all rules tried on the whole text."""
    text, at, start = " ".join(words), {}, 0
    for k, w in enumerate(words):
        at[start] = k
        start += len(w) + 1
    found = [(at[m.start()], at[m.start()] + len(m[0].split()), rule) for rule, expression, _ in compiled for m in expression.finditer(text)]
    return suppressed(found)


def is_kept(text: str | None) -> bool:
    """The verdict of all eight rules."""
    text = text or ""
    c, words = rule_counts(text), WORD.findall(text)
    inside = [b for w in words for b in w.encode()]
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in inside)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return not (
        c["base_failed"]
        or 10 * c["n_symbols"] > 2 * c["n_words"]
        or 2 * sum(65 <= b <= 90 for b in inside) > letters
        or 10 * letters < 6 * len(inside)
        or not 2 * c["n_words"] <= c["word_chars"] <= 16 * c["n_words"]
        or 10 * c["n_dup_lines"] > 3 * len(lines)
        or 10 * max(Counter(words).values(), default=0) > 4 * c["n_words"]
    )


def url_templates(rows: list[tuple]) -> dict:
    """page_id: (template, verdict) from rows (page_id, url, bad), by a recursion over the tree of each host."""
    import math

    from leafmill.llm.url_tree import APART, BAR, BINS, PRIOR, SUPPORT

    known = [bad for _, _, bad in rows if bad is not None]
    overall = (sum(known) + 1) / (len(known) + 2)
    share = lambda b, n: (b + PRIOR * overall) / (n + PRIOR)

    def differ(b1, n1, b2, n2):
        pooled = (b1 + b2 + 2 * PRIOR * overall) / (n1 + n2 + 2 * PRIOR)
        return abs(share(b1, n1) - share(b2, n2)) > APART * math.sqrt(pooled * (1 - pooled) * (1 / (n1 + PRIOR) + 1 / (n2 + PRIOR)))

    def typed(s):
        s = re.sub(r"^\d+(?=$|\.[a-z]{1,5}$)", "{n}", s)
        return re.sub(r"^(?=[0-9a-f]*\d)[0-9a-f-]{8,}(?=$|\.[a-z]{1,5}$)", "{x}", s)

    nodes: dict = {}
    for page, url, bad in rows:
        facts = url_facts(url)
        nodes.setdefault((facts["host"], ""), []).append((page, [typed(s) for s in facts["path"].removeprefix("/").split("/")], bad))
    template = {}
    counts = lambda some: (sum(b or 0 for _, _, b in some), sum(b is not None for _, _, b in some))
    level = 0
    while nodes:
        new: dict = {}
        for (host, prefix), members in nodes.items():
            if len({tuple(segs) for _, segs, _ in members}) == 1:
                for page, segs, _ in members:
                    template[page] = (host, "/".join([prefix, *(s if "{" in s else "*" for s in segs[level:])]))
                continue
            children: dict = {}
            for m in members:
                if len(m[1]) > level:
                    children.setdefault(m[1][level], []).append(m)
            # Paths that ended here have no segment; they are finished one level before.
            nb, nl = counts([m for c in children.values() for m in c])
            bins: dict = {}
            for seg, c in children.items():
                cb, cl = counts(c)
                if len(c) >= SUPPORT and nl > cl and differ(cb, cl, nb - cb, nl - cl):
                    bins.setdefault(min(math.floor(2 * math.asin(math.sqrt(share(cb, cl))) / math.pi * BINS), BINS - 1), []).append(seg)
            groups: list = []
            for k in sorted(bins):
                b, n = (sum(counts(children[s])[i] for s in bins[k]) for i in (0, 1))
                if groups and not differ(b, n, groups[-1][0], groups[-1][1]):
                    groups[-1] = (groups[-1][0] + b, groups[-1][1] + n, groups[-1][2] + bins[k])
                else:
                    groups.append((b, n, bins[k]))
            of = {s: (str(k), len(g[2])) for k, g in enumerate(groups, 1) for s in g[2]}
            for seg, c in children.items():
                number, size = of.get(seg, ("", 0))
                step = seg if size == 1 or (counts(c)[1] == nl and "{" in seg) else f"*{number}"
                for m in c:
                    if len(m[1]) == level + 1:
                        template[m[0]] = (host, f"{prefix}/{step}")
                    else:
                        new.setdefault((host, f"{prefix}/{step}"), []).append(m)
        nodes, level = new, level + 1
    sums: dict = {}
    for page, _, bad in rows:
        b, n = sums.get(template[page], (0, 0))
        sums[template[page]] = (b + (bad or 0), n + (bad is not None))
    return {page: (t[1], "block" if sums[t][1] and share(*sums[t]) >= BAR else "allow") for page, t in template.items()}
