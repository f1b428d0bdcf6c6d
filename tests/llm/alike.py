"""Pairs of different texts that weak hashes take for the same."""


def mirrored(doublings=11):
    """Two texts of 2**doublings letters; polynomials modulo 2**64 with an odd base have one value for both."""
    text = "a"
    for _ in range(doublings):
        text += text.translate({97: 98, 98: 97})
    return text, text.translate({97: 98, 98: 97})
