"""Secrets that stand several times in a text, and secrets of letters only."""

from boxlake.llm.secrets import redacted, scan

KEY = "q7Zt3Lx9Vb2Nw8Rk5Jd1Hf6Gs4Pa0Ym"
PROSE = "The river runs slowly past the old mill and nobody there remembers who built it. " * 3


def novel(text):
    return [text[a:z] for k, a, z in scan(text) if k == "novel"]


def test_repeats_do_not_hide_each_other():
    for gap in (" and ", PROSE, "x" * 460 + " ", "x" * 470 + " ", "y " * 240, "y " * 251):
        text = f"{PROSE} my credential is {KEY}{' '}{gap}{' auth '}{KEY} {PROSE}"
        assert novel(text) == [KEY, KEY]
        assert KEY not in redacted(text, scan(text))


def test_all_occurrences_of_a_found_string():
    far = "Nothing of the sort stands here, only plain prose. " * 30
    text = f"{KEY} {far} my credential is {KEY} {far} url/{KEY}=x"
    assert novel(text) == [KEY, KEY, KEY]
    assert scan(f"{KEY} {far}") == []
    spans = scan(f"the auth credential {KEY} then password={KEY}")
    assert [s[0] for s in spans] == ["novel", "assign"]


def test_letters_only():
    key = "qXvZtLbNwRkJdHfGsPaYmCeUo"
    assert novel(f"my credential is {key} here") == [key]
    assert novel(f"my credential is {'-' * 40} here") == []
