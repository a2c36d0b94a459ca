"""Documents that the tests share."""

import random

DOC_TYPE = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators also use inside.
CLASHING = "doc string, size string, target string, copies string, fp string, spans string, x string, score string, h string, w string, row string, id string, digest string"


def prose(rng: random.Random, words: int, syllables: str = "an er on en re nt th ti ou es") -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Documents with every kind of trouble: nulls, empty, long, copies, near copies, repeated rows."""
    rng = random.Random(3)
    shared = prose(rng, 60)
    long = prose(rng, 30_000)
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", "en", "b", 3),
        (4, "Ein Würfel für Ölbäume — ① ②", "de", "b", 28), (5, long, "en", "a", len(long)), (6, long, "en", "c", len(long)),
        (7, shared, "en", "a", len(shared)), (7, shared, "en", "a", len(shared)), (8, "lead " + shared + " tail", "en", None, 10),
        (9, shared + " " + shared, None, "c", 5), (None, shared, "en", "a", 5), (None, None, "en", "a", None),
        (10, "### $$$ 12345 %%%", "en", "b", 17), (11, "\U0001f600 \U0001f601 " * 30, "en", "b", 120),
    ]
    for k in range(12, 60):
        text = prose(rng, rng.randint(5, 200), "an er on en re nt th ti ou es" if k % 2 else "le la qu ai eu ou re de tr es")
        rows.append((k, text + (" " + shared if k % 9 == 0 else ""), "en" if k % 2 else "fr", "abc"[k % 3], len(text)))
    return rows
