from textwarrant.operators import foreign


def letters(i):
    """A number as letters: quotations are compared by these alone."""
    return "".join(chr(ord("a") + int(d)) for d in str(i))


def test_pairs_of_quotations_and_wordings_are_not_rows(spark, monkeypatch):
    texts = [(f"t{i}", "verse", "en", f"r{i}", f"shared river stone own{letters(i)} mark{letters(i % 40)}") for i in range(400)]
    wordings = spark.createDataFrame(texts, "text_id string, kind string, lang string, reference string, text string").coalesce(1)
    asked = [(q, "en", f"shared river stone own{letters(q)} mark{letters(q)}", None, None) for q in range(20)]
    quotes = spark.createDataFrame(asked, "quote_id long, lang string, text string, hint string, given string")
    seen = []
    score = foreign.best_of_texts
    monkeypatch.setattr(foreign, "best_of_texts", lambda *a, **more: seen.append(score(*a, **more)) or seen[-1])
    found = foreign.match_quotations(quotes, wordings, {"verse": 0.6}, k=5, max_df_share=1.0)
    assert {r.quote_id: (r.text_id, r.status) for r in found.collect()} == {q: (f"t{q}", "verified") for q in range(20)}
    # every wording shares a word with every quotation
    assert sum(df.count() for df in seen) < 20 * 400 / 2
