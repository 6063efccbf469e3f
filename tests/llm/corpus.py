"""Small corpora with copies, shared passages, junk, empty and null texts and repeated rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Rows of ``documents`` in which every kind of repeat occurs."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["naïve", "ñandú", "ß", "日本"]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, line = words(60), " ".join(words(12))
    texts = []
    for i in range(n):
        k = i % 12
        if k == 0:
            t = words(r.randint(1, 30))
        elif k == 1 and texts:
            t = (texts[r.randrange(len(texts))] or "x").split(" ")
        elif k == 2:
            t = words(40) + passage + words(r.randint(0, 40))
        elif k == 3 and len(texts) > 5:
            t = (texts[r.randrange(len(texts))] or "y").split(" ")
            t = [w if r.random() > 0.02 else "edit" for w in t]
        elif k == 4:
            t = ["la", "lo"] * r.randint(30, 120)
        elif k == 5:
            t = words(20) + [line] + words(30) + ["\n" + line] + ["\t\n"] + passage[:36]
        elif k == 6:
            half = words(50)
            t = half + words(3) + half
        else:
            t = words(r.randint(30, 200))
        texts.append(" ".join(t) if r.random() > 0.1 else "  " + "\n".join(t) + " ")
    texts += [None, "", " ", "one", "one", "two words", "x" * 3000, "x" * 900, "ab" * 700]
    rows = [(i, t, None if i % 17 == 0 else "en", None if i % 13 == 0 else "s%d" % (i % 5), None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[7], rows[7], (None, texts[9], None, None, None)]
