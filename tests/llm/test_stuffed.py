import random

from lexspark.llm import stuffed

DOC = "doc_id long, text string, lang string, share double"
PROSE = [
    "The trustee must not amend the register of transfers before the first annual meeting of the company.", "A director may file the certificate at the office, and the board is required to keep it.",
    "If the secretary fails to act in good faith, the court may set aside the resolution on the terms that it considers fit.",
]
FRENCH = ["Le fiduciaire ne doit pas modifier le registre des transferts avant la première assemblée annuelle de la société.", "Un administrateur peut déposer le certificat au siège social, et le conseil est tenu de le conserver."]


def spam(rng, kind, n=40):
    keys, towns = rng.sample(["company seal", "shelf company", "name search", "minute book", "trademark agent"], 2), ["Ostrel", "Kelvane", "Tamrick"]
    items = [rng.choice([f"{rng.choice(keys)} {rng.choice(towns)}", f"{rng.choice(['fast', 'cheap'])} {rng.choice(keys)}"]) for _ in range(n)]
    if kind == 0:
        return rng.choice([" | ", "; ", "\n", " "]).join(items)
    if kind == 1:
        return "\n".join(f"[{i}](https://x.example/p?id={k})" for k, i in enumerate(items))
    if kind == 2:
        return "\n".join(f"SKU {rng.randrange(9999)} {rng.choice(keys)}, vinyl, 47.99, in stock" for _ in range(n))
    return " ".join(f"#{i.replace(' ', '-')}" for i in items)


def pages(seed=1):
    rng = random.Random(seed)
    rows, want = [], set()
    for d in range(160):
        prose = " ".join(rng.choice(PROSE if d % 3 else FRENCH) for _ in range(60))
        kind = d % 8
        if kind < 4:
            text = spam(rng, kind)
            want.add(d)
        elif kind == 4:
            text = prose
        elif kind == 5:
            text = prose + "\n" + spam(rng, rng.randrange(4), 5)  # a footer
        elif kind == 6:
            text = "Pensions Act 385\n" + "\n".join(f"{i}. {rng.choice(['Pensions', 'Trusts', 'Timber'])} Act {rng.randrange(900)}, Ostrel 19{i:02} ..... {2 * i}" for i in range(1, 40))
        else:
            text = "\n".join(f"Item {i}: in good faith, file the annual return: {rng.randrange(900)} crowns" for i in range(30))
        rows.append((d, text, None if d % 2 else "fr", 0.5))
    return rows, want


def found(spark, rows):
    return {r["doc_id"] for r in stuffed.find_stuffed_pages(spark.createDataFrame(rows, DOC)).collect()}


def test_planted_pages(spark):
    rows, want = pages()
    assert found(spark, rows + rows[:8]) == want


def test_edges(spark):
    rows, want = pages()
    odd = [(900, None, None, None), (901, "", None, None), (902, " \n \t", None, None), (903, "one", None, None), (904, "- - - | | |", None, None), (905, "https://a.example/b " * 20_000, "en", None), (906, " ".join(PROSE) * 3000, None, None)]
    got = found(spark, rows + odd)
    assert got - set(range(900, 910)) == want and 905 in got and not {900, 901, 902, 906} & got
    assert found(spark, odd[:3]) == set() and stuffed.find_stuffed_pages(spark.createDataFrame([], DOC)).count() == 0


def test_share_counts_characters():
    assert stuffed.stuffed_share([10, 30], [0.5, 0.0], [0.0, 1.0], [0.0, 0.0], stuffed.Usual(0.54)) == 0.75
    assert stuffed.stuffed_share([], [], [], [], stuffed.Usual(0.54)) == 0.0


def test_single_keywords_repeated_lines_and_one_numbered_line(spark):
    rows, want = pages()
    rng = random.Random(4)
    keys = "sale cheap vinyl deal offer price shoes boots".split()
    one_a_line = "\n".join(rng.choice(["sale", "cheap"]) for _ in range(200))
    shuffled = " ".join(rng.choice(keys) for _ in range(300))
    repeated = "\n".join(["Company seals fast delivery Ostrel", "Minute books best price Kelvane"] * 20)
    priced = " ".join(f"{rng.choice(['fast', 'cheap'])} company seal" for _ in range(60)) + " 1999"
    odd = [(900 + i, t, "en", None) for i, t in enumerate([one_a_line, shuffled, repeated, priced, "2024 " + shuffled])]
    assert found(spark, rows + odd) == want | {900, 901, 902, 903, 904}


GERMAN = [
    "Der Vorstand darf die Satzung der Gesellschaft nicht ohne die Zustimmung der Mitglieder ändern, und er hat das Register in der vom Gesetz bestimmten Form zu führen.",
    "Wenn ein Mitglied mit der Zahlung in Verzug ist, kann das Gericht auf Antrag der Gesellschaft eine Frist setzen, nach der die Anteile an die Gesellschaft fallen.",
    "Die Frist beginnt mit dem Tag, an dem der Beschluss der Versammlung den Mitgliedern in der vom Gesetz bestimmten Form mitgeteilt worden ist.",
]


def test_a_language_without_a_list_is_learned(spark):
    rows, want = pages()
    rng = random.Random(6)
    for d in range(300, 360):
        rows.append((d, " ".join(rng.choice(GERMAN) for _ in range(40)), "de", None))
    for d in range(360, 372):
        keys = rng.sample(["Firmensiegel kaufen", "Mantelgesellschaft billig", "Namenssuche online", "Protokollbuch Leder", "Markenanwalt Beratung"], 2)
        rows.append((d, rng.choice([" | ", "; ", " "]).join(f"{rng.choice(keys)} {rng.choice(['Ostrel', 'Kelvane', 'schnell'])}" for _ in range(60)), "de", None))
    df = spark.createDataFrame(rows, DOC)
    known = stuffed.learned_function_words(df)
    assert set(known) == {"de"} and {"der", "die", "mit"} <= known["de"]
    langs = {r["doc_id"]: r["lang"] for r in stuffed.page_table(df).collect()}
    assert {langs[d] for d in range(300, 360)} == {"de"}
    assert found(spark, rows) == want | set(range(360, 372))
