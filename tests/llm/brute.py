"""Plain statements of what the operators return, slow and short, to hold their results against."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Texts with the odd cases: null, empty, blank, copies, long, odd white space, other scripts.
TEXTS = [
    None, "", " \n\t ", "one", "one two three four", "One two three FOUR", "a b c d e f g", "a b c d e f g", "A\x0bb\x0cc\rd\te  f g",
    "x" * 5000, "word " * 3000, "l1 w\nl1 w\n\nl2\nl1 w\n \n", "éa êb çc öd ñe ßf", "日本語 テスト 😀 😀 words and 12 34", "# * $ % & | < > ##", "a b c d\u0085e",
    "<|endoftext|> it's we'll 'x ''s  two  blanks \r\n", " ".join(f"w{i}" for i in range(4000)), "READ THIS NOW!! WHY!! STOP!! AT!! ONCE!! OR!! ELSE!! SO!! BE!! IT!! ALL",
]


def words(text):
    return WORD.findall(text or "")


def simhash(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    """Smallest node reachable from each."""
    out = {}
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        out[n] = n
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in out and linked(x, y):
                    out[y] = n
                    todo.append(y)
    return out


def base(text):
    w = words(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in wins:
        count[x] = count.get(x, 0) + 1
    hit = {j for i, x in enumerate(wins) if count[x] > 1 for j in range(i, i + 5)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in full[:i] for i, x in enumerate(full))
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 10 or 100 * len(hit) > 20 * n


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
