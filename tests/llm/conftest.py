import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "ra sti lon der mak tus pen vor".split()]


@pytest.fixture
def prose():
    """Invented sentences, the same ones for the same seed."""

    def make(seed: int, n: int = 60, vocabulary: list[str] = WORDS) -> str:
        rng = random.Random(seed)
        out, line = [], []
        for i in range(n):
            line.append(rng.choice(vocabulary) + str(rng.randrange(60)))
            if len(line) == 7 or i == n - 1:
                out.append(" ".join(line).capitalize() + ".")
                line = []
        return " ".join(out)

    return make


@pytest.fixture
def documents(spark):
    """A documents table with extra columns whose names clash with names used inside the operators."""

    def make(rows):
        data = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, id int, component string")

    return make
