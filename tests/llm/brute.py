"""Slow and plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    own = words(text)
    lines, seen, repeated_lines = [line for line in text.split("\n") if words(line)], set(), 0
    for line in lines:
        repeated_lines += line in seen
        seen.add(line)
    places = defaultdict(list)
    for k in range(len(own) - 2):
        places[tuple(own[k : k + 3])].append(k)
    covered = {k + i for at in places.values() if len(at) > 1 for k in at for i in range(3)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), repeated_lines, len(covered)


def shingles(text, width):
    own = words((text or "").translate(LOWER))
    if 0 < len(own) < width:
        return {tuple(own)}
    return {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}


def components(docs, width, percent=80):
    """{id: (number of shingles, component)} of (id, text) rows."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                    low, high = sorted((top(i), top(j)))
                    root[high] = low
    return {i: (len(s), top(i)) for i, s in sets}


def passages(docs, length):
    """(doc_id, start_word, n_words, earlier_doc_id) of (id, text) rows with ids of their own."""
    first, found = {}, []
    for i, text in sorted((i, t) for i, t in docs if i is not None and t is not None):
        if text in first:
            if len(words(text)) >= length:
                found.append((i, 0, len(words(text)), first[text]))
        else:
            first[text] = i
    windows = {}
    for text, i in sorted(first.items(), key=lambda x: x[1]):
        own, last = words(text), None
        for start in range(len(own) - length + 1):
            doc = windows.setdefault(tuple(own[start : start + length]), (i, start))
            if doc == (i, start):
                continue
            if last is not None and start <= last[1] + last[2]:
                last[2] = start - last[1] + length
            else:
                last = [i, start, length, doc[0]]
                found.append(last)
    return sorted(tuple(x) for x in found)


def without(text, spans):
    """A text without spans (start_word, n_words) and the separators behind them."""
    begins = [m.start() for m in WORD.finditer(text)] + [len(text)]
    gone = {k for start, n in spans for k in range(start, start + n)}
    left = text[: begins[0]] + "".join(text[begins[k] : begins[k + 1]] for k in range(len(begins) - 1) if k not in gone)
    return left if words(left) else ""
