"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, digest int, _id int"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 120)))
        out.append((i, text, "en", f"s{i % 4}"))
    base = out[3][1]
    out += [(n + k, base, "en", "s0") for k in range(5)]  # exact copies
    out += [(n + 5, " ".join(base.split()) + "\n", "en", "s1"), (n + 6, base.replace(" ", "\t"), None, None)]
    changed = out[7][1].split()
    out += [(n + 10 + k, " ".join([*changed[:k], "changed", *changed[k + 1 :]]), "en", "s2") for k in range(4)]
    out += [(n + 20, None, None, None), (n + 21, "", "en", "s1"), (n + 22, " \t\n", "en", "s1"), (None, "a row without an id", "en", "s3"), (None, None, "en", "s3")]
    out += [(n + 30, "the " * 30_000, "en", "s3"), (n + 31, "X" * 50_000, "en", "s3")]
    out += [out[5], out[5]]  # repeated rows
    return out


def documents(spark, given=None):
    given = rows() if given is None else given
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1, 2) for r in given], DOCS)
