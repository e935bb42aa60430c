"""Documents that hold every awkward case, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def corpus(seed=3, n=60):
    """Copies, near copies, shared passages, repeats within a text, one very long text, empty, null and short texts."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(80)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocab) for _ in range(r.choice([0, 3, 12, 13, 14, 40, 90, 200])))
        kind = i % 6
        if kind == 1 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 2 and rows:
            other = words(rows[r.randrange(len(rows))][1])
            if other:
                other[r.randrange(len(other))] = "zz"
            text = "  ".join(other)
        elif kind == 3:
            text = f"{text}\n\t{passage}\r\n{text[: len(text) // 2]}"
        elif kind == 4:
            text = f"{text} {text} \x0b{text}"
        rows.append((r.randrange(10 * n) * 2 + 1, text, r.choice(["en", "fr", None]), r.choice(["a", "b", None]), len(text)))
    rows += [(2, None, None, None, None), (4, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4), (8, " ".join(vocab * 60), "fr", "b", 9)]
    rows += [rows[3], rows[3], rows[9]]
    seen, out = set(), []
    for x in rows:
        if x[0] in seen and x not in out:
            continue
        seen.add(x[0])
        out.append(x)
    return [*out, (None, passage + " tail", "en", "a", 1), (None, None, None, None, None)]
