"""Invariants of the plain Python helpers over random inputs."""

from hypothesis import given, strategies as st

from propflow.functions.keywords import keyword_pattern, quoted, smallest_cover
from propflow.functions.text import mention_windows
from propflow.sources.tables import snake

letters = st.text("abAB .", max_size=40)
words = st.text("ab.", min_size=1, max_size=3)


@given(letters, words, st.none() | words, st.integers(1, 9))
def test_every_window_holds_its_mention(text, name, alias, window):
    found = list(mention_windows(text, name, alias, window))
    assert [start for start, _ in found] == sorted(start for start, _ in found)
    for start, snippet in found:
        assert snippet == text[max(0, start - window) : start + window]
        assert any(text.lower().startswith(w, start) for w in (name, alias) if w)
    counted = sum(text.lower().count(w) for w in (name, alias) if w)
    assert len(found) == counted


@given(st.lists(words, max_size=6), letters)
def test_the_cover_matches_what_all_words_match(keywords, text):
    cover = smallest_cover(keywords)
    assert any(w in text for w in cover) == any(w in text for w in keywords)
    assert all(a not in b for a in cover for b in cover if a != b)


@given(words)
def test_quoting_marks_the_word_once(word):
    assert quoted(word) == f"\\Q{word}\\E"
    assert keyword_pattern([word, word], "word").count(word) >= 1


def test_snake_names():
    names = ["DSSTOX_SUBSTANCE_ID", "PubChemCID", "4_hr_value_mgL", "QSAR_READY_SMILES", "Inhalation_Db_Index", "Data"]
    assert [snake(n) for n in names] == [
        "dsstox_substance_id", "pub_chem_cid", "4_hr_value_mgl", "qsar_ready_smiles", "inhalation_db_index", "data",
    ]
