import numpy as np

from posledger.llm import kernels as K


def parity(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n)).encode()


def test_words_of_the_parity_sequence_differ():
    """Polynomials modulo a power of two can't tell these from their complements, whatever the values and the point."""
    for n in (1024, 2048, 4096, 1 << 16):
        w = K.Words([parity(n, 0), parity(n, 1), parity(n, 0)])
        assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
        for letter in (b"x", b"word "):  # blocks and words in place of letters
            a, b = (K.Words([b" ".join(letter * 9 if c == 97 else b"other" for c in parity(n, k))]) for k in (0, 1))
            ra, rb = (K.Rolling(x.hash, 1)(np.array([0]), np.array([len(x)])) for x in (a, b))
            assert ra[0] != rb[0]


def test_equal_runs_have_equal_hashes_and_others_do_not():
    r = np.random.default_rng(5)
    data = r.integers(0, 3, 3000).astype(np.uint8) + 97
    h = K.Rolling(K.BYTES[data])
    at = np.arange(len(data) - 7)
    hashes = h(at, at + 7)
    strings = [data[i : i + 7].tobytes() for i in at]
    assert len(set(hashes.tolist())) == len(set(strings))
    assert len(set(zip(hashes.tolist(), strings))) == len(set(strings))
    assert len(set(h(np.zeros(3000, int), np.arange(1, 3001)).tolist())) == 3000
