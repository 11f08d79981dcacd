"""Small document tables with every awkward case: nulls, empties, copies, long texts, clashing columns."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ("th string, n long, k string, row long, label string, base string, score double, path string, part string, "
       "ids string, kept string, grp string, m string, start string, doc string")


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab):03x}" + rng.choice(["", "", ".", ","]) for _ in range(n)]


def documents(seed=5):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 5, 60, 80, 120, 200, 400)]
    passage = words(rng, 57)
    texts = [" ".join(b) for b in base]
    texts += [texts[3], texts[3], texts[5]]  # exact copies
    for b in base[3:]:
        for k in range(4):  # near copies
            c = list(b)
            for _ in range(1 + k):
                c[rng.randrange(len(c))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(c))
    for _ in range(6):  # a shared passage in different surroundings
        texts.append(" ".join(words(rng, rng.randrange(5, 40)) + passage + words(rng, rng.randrange(5, 40))))
    texts += [" ".join(passage[:52]), " ".join(passage[4:]), " ".join(words(rng, 5000)), "a " * 300, "same line here\n" * 30]
    texts += [None, "", " \t\n ", "one", "two words", "x y  z", "tab\tand\x0bvt\x0cff\rcr", "É" * 120, "q" * 3000]
    texts += ["Mixed CASE Words are HERE now", "mixed case words ARE here NOW", "special <|endoftext|> inside", "  lead", "trail  ", "a \n b\n\n c   d \n"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, odd=False):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    if odd:
        from pyspark.sql import functions as F

        for c in ODD.split(", "):
            name, kind = c.split()
            df = df.withColumn(name, F.lit("9").cast(kind))
    return df
