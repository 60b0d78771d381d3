import random

import pytest

from boxlore.llm import pii


@pytest.mark.parametrize("n", [40, 128, 129, 400, 3000])
def test_a_long_secret_is_redacted_whole(n):
    rng = random.Random(n)
    secret = "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    text = f"please use token={secret} for this call"
    assert pii.redact(text, pii.find(text, *pii.model())[1]) == "please use token=[SECRET] for this call"
