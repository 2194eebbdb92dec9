import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[(seed >> 8) % 20] + WORDS[(seed >> 13) % 20])
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, and columns with clashing names."""
    base = prose(7, 120)
    words = base.split()
    texts = [
        base, base.upper(), " ".join(words[:60] + ["other"] + words[61:]), " ".join(words[:30]), None, "", "  \n\t", "a b c", "A  b\nc",
        prose(9, 3000) + " joe.x@mail.example.com end", "x" * 50_000, "same line here\n" * 60, "ñ 10.0.0.7 é 1.2.3.400 +1 (319) 555-5132 x 4111 1111 1111 1111 a@@b@c.de.f",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction; sublicense. substantial portions of the Software",
        "gnu general public license cc by cc by", "$$$ %%% &&& ***",
    ]
    rows = [(i, t, "w", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "w", 1), (None, base, "w", 1), (None, "alone text without id here", "w", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, n_words long").cache()
