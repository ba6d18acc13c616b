import random

import pytest

WORDS = "the of and river stone cloud paper engine window garden silver mountain copper lantern harbor violet thunder meadow cobalt ember saddle willow canyon marble".split()


@pytest.fixture
def prose():
    def make(seed: int, n: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))

    return make
