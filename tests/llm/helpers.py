"""Small document tables with the awkward cases, and brute-force versions of
the operators in plain Python."""

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, th string, words string"

VOCABULARY = ["ash", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine", "rowan", "spruce", "willow", "yew"]


def rows(seed=3, n=60):
    """Documents with copies, near copies, shared passages, ties, null and empty
    texts, very long texts, odd white space and columns whose names clash."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(k))
    passage, out = say(70), []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = None
        elif kind == 1:
            text = ""
        elif kind == 2:
            text = " \n\t \n"
        elif kind == 3 and out:
            text = rng.choice(out)["text"]
        elif kind == 4:
            text = say(30) + "\n" + passage + "\n" + say(20)
        elif kind == 5:
            words = (out[4]["text"] if len(out) > 4 else say(90)).split()
            words[rng.randrange(len(words))] = "edit" + str(i)
            text = " ".join(words)
        elif kind == 6:
            text = "oak " * 120
        elif kind == 7:
            text = "É " + say(3) + "\r\n" + say(12) + "\x0b" + say(5) + " ß日本"
        else:
            text = "\n".join(say(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6)))
        out.append({"doc_id": i * 3, "text": text, "lang": rng.choice(["en", "de", None]), "source": rng.choice(["src0", "src1", None]),
                    "n_chars": len(text or ""), "did": 1, "th": "x", "words": None})
    out.append({**out[8], "text": say(4000)})       # an id twice, and a long text
    out.append(dict(out[9]))                        # a row twice
    out.append({**out[4], "doc_id": None})          # no id
    return out


def frame(spark, data):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in data], SCHEMA)


def plain(data):
    """One row an id, none without an id: what the brute-force versions take."""
    seen, out = set(), []
    for r in data:
        if r["doc_id"] is not None and r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            out.append(r)
    return out


def repeated_windows(data, size):
    """doc_id -> kept words: a word covered by a window that also starts in a smaller id goes."""
    first, kept = {}, {}
    for r in sorted(data, key=lambda r: r["doc_id"]):
        words = (r["text"] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if first.setdefault(tuple(words[i:i + size]), r["doc_id"]) < r["doc_id"]:
                gone[i:i + size] = [True] * size
        kept[r["doc_id"]] = b" ".join(w for w, g in zip(words, gone) if not g).decode()
    return kept


def later_lines(data, threshold=0.8, least=5):
    lines, gone = [], set()
    for r in sorted(data, key=lambda r: r["doc_id"]):
        for k, line in enumerate((r["text"] or "").split("\n")):
            words = {w for w in line.encode().split()}
            if len(words) >= least:
                if any(len(words & w) >= threshold * len(words | w) - 1e-9 for w in lines):
                    gone.add((r["doc_id"], k))
                lines.append(words)
    return gone


def components(fps, bits=3):
    """doc_id -> smallest id reachable, from doc_id -> fingerprint."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def counts(texts):
    out = Counter()
    for t in texts:
        out.update(t)
    return out
