import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, row string, id string, hash long, n_words string"


def sample_docs(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose with exact and near copies, repeated lines and passages, and every odd case."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 7)))
    line = lambda k: " ".join(word() for _ in range(k)) + "."
    common, texts = line(26), []
    for i in range(n):
        if i % 7 == 3:
            texts.append(texts[r.randrange(len(texts))])
        elif i % 7 == 5:
            words = texts[r.randrange(len(texts))].split(" ")
            if len(words) > 5:
                words[r.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            body = [line(r.randint(3, 30)) for _ in range(r.randint(1, 6))]
            if i % 4 == 0:
                body.insert(r.randint(0, len(body)), common)
            texts.append("\n".join(body))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "éa#* \U0001f600 %"), (n + 4, "word " * 30_000), (n + 5, "a\nb\n\nc"), (n + 6, "x y"), (n + 6, "x y"), (0, rows[0][1]), (1, "another text of the same id " * 9)]
    return [(i, t, None if i % 9 == 4 else "en", None if i % 11 == 7 else f"s{i % 3}" if i % 2 else "hot", len(t or ""), None, 5, "r", "i", 1, "w") for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(sample_docs(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
