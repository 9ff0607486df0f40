"""Rows that hold every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, keys string, low int"


def make_docs(seed=1, n=120):
    """Rows with copies, near copies, shared passages, empty, null, short and long texts; nulls in every column, a repeated row, clashing extra columns."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and", "Größe", "naïve", "été,", "日本語", "x\u00a0y"]
    text = lambda k: "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in rng.choices(vocabulary, k=k))
    passage, out = text(60), []
    for i in range(n):
        kind = i % 8
        base = out[rng.randrange(len(out))][1] if out and kind in (1, 2) else None
        if kind == 1 and base:
            t = base
        elif kind == 2 and base:
            w = base.split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = text(rng.randrange(20, 90)) + passage + text(30)
        elif kind == 4:
            t = text(rng.randrange(0, 8))
        else:
            t = text(rng.randrange(60, 300))
        out.append((i, t))
    out += [(n, ""), (n + 1, None), (n + 2, " \n\t "), (n + 3, text(9000)), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "a" * 5000)]
    return out


def as_rows(pairs):
    langs = ["en", "de", None, "xx", "fr"]
    return [(d, t, langs[d % 5], None if d % 7 == 0 else "s", None if t is None else len(t), "n", None, d) for d, t in pairs]
