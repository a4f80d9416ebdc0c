"""op7 counts of pre-tokens with a million tokens and more."""

from gridloom.llm import token_counts


def test_count_of_a_very_long_pretoken():
    scores = token_counts.piece_scores({bytes([k]): k for k in range(256)})
    size = (1 << 20) + 5
    assert token_counts.trie_counts([b"x" * size, b"xy"], scores) == {b"x" * size: size, b"xy": 2}
