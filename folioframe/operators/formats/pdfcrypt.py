"""The standard security handler of PDF with the empty user password: RC4 and AES-128."""

from __future__ import annotations

import hashlib

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray(len(data))
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _boxes() -> tuple[bytes, bytes]:
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = bytearray(256)
    for v in range(256):
        b = exp[255 - log[v]] if v > 1 else v
        r = b
        for k in range(1, 5):
            r ^= ((b << k) | (b >> (8 - k))) & 255
        box[v] = r ^ 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


_BOX, _BACK = _boxes()


def _times(a: int, b: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        a = ((a << 1) ^ 0x1B) & 255 if a & 0x80 else a << 1
        b >>= 1
    return r


_M = {k: bytes(_times(v, k) for v in range(256)) for k in (9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    words = [key[i : i + 4] for i in range(0, 16, 4)]
    rcon = 1
    for i in range(4, 44):
        t = words[-1]
        if i % 4 == 0:
            t = bytes(_BOX[b] for b in t[1:] + t[:1])
            t = bytes([t[0] ^ rcon]) + t[1:]
            rcon = _times(rcon, 2)
        words.append(bytes(a ^ b for a, b in zip(words[i - 4], t)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


_SHIFT = [0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3]


def _block(keys: list[bytes], b: bytes) -> bytes:
    s = bytes(x ^ y for x, y in zip(b, keys[10]))
    m9, m11, m13, m14 = _M[9], _M[11], _M[13], _M[14]
    for r in range(9, -1, -1):
        k = keys[r]
        s = bytes(_BACK[s[_SHIFT[i]]] ^ k[i] for i in range(16))
        if r:
            out = bytearray()
            for c in range(0, 16, 4):
                a, b_, d, e = s[c : c + 4]
                out += bytes((m14[a] ^ m11[b_] ^ m13[d] ^ m9[e], m9[a] ^ m14[b_] ^ m11[d] ^ m13[e], m13[a] ^ m9[b_] ^ m14[d] ^ m11[e], m11[a] ^ m13[b_] ^ m9[d] ^ m14[e]))
            s = bytes(out)
    return s


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Decrypted data, whose first block is the initial vector; padding taken off."""
    keys, before, out = _round_keys(key), data[:16], bytearray()
    for i in range(16, len(data) - 15, 16):
        b = data[i : i + 16]
        out += bytes(x ^ y for x, y in zip(_block(keys, b), before))
        before = b
    n = out[-1] if out else 0
    return bytes(out[:-n]) if 0 < n <= 16 else bytes(out)


class Security:
    """Keys for an encryption dictionary; None from make() if the empty password fails."""

    def __init__(self, key: bytes, aes: bool):
        self.key, self.aes = key, aes

    @staticmethod
    def make(d: dict, file_id: bytes) -> Security | None:
        v, r, bits = d.get("V", 0), d.get("R", 0), d.get("Length", 40)
        if d.get("Filter") != "Standard" or r not in (2, 3, 4) or v not in (1, 2, 4) or not 40 <= bits <= 128 or bits % 8:
            return None
        aes = False
        if v == 4:
            scheme = (d.get("CF") or {}).get(d.get("StmF"), {})
            if d.get("StmF") != d.get("StrF") or scheme.get("CFM") not in ("AESV2", "V2"):
                return None
            aes, bits = scheme.get("CFM") == "AESV2", 128
        n = 5 if r == 2 else bits // 8
        h = hashlib.md5(PAD + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
        if r == 4 and d.get("EncryptMetadata") is False:
            h.update(b"\xff\xff\xff\xff")
        key = h.digest()
        for _ in range(50 if r >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        if r == 2:
            good = rc4(key, PAD) == d["U"][:32]
        else:
            u = hashlib.md5(PAD + file_id).digest()
            for i in range(20):
                u = rc4(bytes(b ^ i for b in key), u)
            good = u == d["U"][:16]
        return Security(key, aes) if good else None

    def decrypt(self, data: bytes, number: int, generation: int) -> bytes:
        k = self.key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if self.aes else b"")
        k = hashlib.md5(k).digest()[: min(len(self.key) + 5, 16)]
        return aes_cbc(k, data) if self.aes else rc4(k, data)
