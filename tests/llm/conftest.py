import re

import pytest


@pytest.fixture(scope="session")
def brute_words():
    """Words as the contracts define them: A-Z in lower case, runs of characters other than 0x20 and 0x09-0x0D."""
    return lambda text: re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
