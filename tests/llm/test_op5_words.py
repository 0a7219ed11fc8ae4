"""op5's words, encoded many at a time, against the tokenizer's own ids of whole texts, in few calls."""

import random

import numpy as np

from lumenquery.llm import op5_token_ids as op5


def test_op5_other_words_many_at_a_time():
    own = op5.Encoder(op5.tokenizer_path())
    rng = random.Random(3)
    odd = "a1 x-y İstanbul ΣΑΣ ß STRASSE é ́ ́a ​   a b 　 中文字 한국어 😀😀 👩‍👩‍👧 </w> a</w>b \x00 \x07b ﬁn Ǆ ½ ². ... --- #tag @user http://x.y/z?q=1 ا ب ของ 'tis don't".split(" ")
    odd += ["".join(rng.choices("abcXYZ019-_/+.,é漢́‍", k=rng.randint(1, 14))) for _ in range(4000)]
    texts = [" ".join(rng.choices(odd, k=60)) for _ in range(400)] + ["", "plain words only", own.special[0], f"a {own.special[-1]} b1 c2"]
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, op5.END] for t in texts]

    class Counted:
        calls = 0

        def __init__(self, inner):
            self.inner = inner

        def encode(self, *args, **more):
            Counted.calls += 1
            return self.inner.encode(*args, **more)

    own.tokenizer = Counted(own.tokenizer)
    got = own.encode(texts)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    assert Counted.calls < 1000
