"""Small corpora for the corpus operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    names = ["".join(random.Random(i).choice("aeioubdgklmnprstvé") for _ in range(2 + i % 9)) for i in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def passages(seed: int, docs: int = 60) -> list[tuple[int, str | None]]:
    """Documents that share passages, repeat a word and mix white space."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(5 if seed == 0 else 60)]
    shared = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(4)]
    rows: list[tuple[int, str | None]] = []
    for i in range(docs):
        own: list[str] = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            own += (rng.choice(shared) if kind < 0.5 else [rng.choice(words)] * rng.randint(1, 50) if kind < 0.65
                    else [rng.choice(words) for _ in range(rng.randint(0, 60))])
        rows.append((i, rng.choice([" ", "\n", "  \t"]) + "".join(w + rng.choice([" ", "\n", "\x0b "]) for w in own)))
    rows[5], rows[6], rows[7] = (5, None), (6, ""), (7, rows[8][1])
    rows.append((100, "x" * 3000 + " " + " ".join(["y" * 1500] * 45)))
    rng.shuffle(rows)
    return rows


def edited_lines(seed: int, docs: int = 80) -> list[tuple[int, str | None]]:
    """Documents of lines that are copies of each other up to a few edits."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é😀") for _ in range(rng.choice([3, 15, 16, 17, 18, 30, 60]))) for _ in range(25)]

    def edit(line: str) -> str:
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(line) + 1)
            line = rng.choice([line[:p] + "z" + line[p:], line[:p] + line[p + 1:], line[:p] + "é" + line[p + 1:]])
        return line

    rows: list[tuple[int, str | None]] = [
        (i, "\n".join(rng.choice(["", " \t", edit(rng.choice(base)), edit(rng.choice(base))])
                      for _ in range(rng.randint(0, 7)))) for i in range(docs)]
    rows[3], rows[4] = (3, None), (4, "")
    rng.shuffle(rows)
    return rows


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=lambda r: [(v is not None, str(v)) for v in r])
