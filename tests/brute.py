"""The search's rules in loops, letter by letter."""

CODES = {"T": 1, "C": 2, "A": 4, "G": 8, "R": 12, "Y": 3, "S": 10, "W": 5, "K": 9, "M": 6, "B": 11, "D": 13, "H": 7, "V": 14, "N": 15}
SWAP = dict(zip("ACGTRYSWKMBDHVN-", "TGCAYRSWMKVHDBN-"))


def code(c):
    return CODES.get(c.upper(), 0)


def flip(text):
    return "".join(SWAP.get(c.upper(), c) if c.isupper() or c == "-" else SWAP.get(c.upper(), c).lower() for c in reversed(text))


def strict(c):
    return code(c) if c.upper() in "ACGT" else 0


def position(spec, start, forward, dna):
    first = spec.patterns[0].upper()
    trailing = len(first) - len(first.rstrip("N"))
    return start if forward else start + max(max(trailing - 1, 0) - dna, 0)


def mismatch_sites(name, seq, spec):
    out, n = [], spec.length
    for pattern in (p.upper() for p in spec.patterns):
        for s in range(len(seq) - n + 1):
            for forward in (True, False):
                # letters without a code, and N, are nothing here
                w = "".join(c.upper() if code(c) else "0" for c in seq[s : s + n])
                w = w if forward else flip(w)
                if any(f.upper() != "N" and not strict(c) & code(f) for c, f in zip(w, spec.motif)):
                    continue
                mm = sum(p != "N" and not strict(c) & code(p) for c, p in zip(w, pattern))
                agreed = sum(bin(code(p) & (0 if c == "N" else code(c))).count("1") for c, p in zip(w, pattern))
                if mm > spec.max_mismatches or (spec.strict_gate and n - agreed > spec.max_mismatches):
                    continue
                shown = "".join(("N" if c in "0N" else c) if p == "N" or strict(c) & code(p) else ("n" if c in "0N" else c.lower()) for c, p in zip(w, pattern))
                out.append(("X", pattern, shown, name, position(spec, s, forward, 0), "+" if forward else "-", mm, 0))
    return out


def bulge_sites(name, seq, spec):
    """Every column sequence is tried at every start, on the strand as it is read."""
    out, letters = [], "".join(c.upper() if code(c) else "0" for c in seq)
    for pattern in (p.upper() for p in spec.patterns):
        n = len(pattern)
        wild = [c == "N" for c in pattern]
        for forward in (True, False):
            text = letters if forward else flip(letters)

            def walk(i, j, columns, mm, dna, rna, start):
                if i == n:
                    if j > start:
                        out.append((columns, start, j, mm, dna, rna))
                    return
                if dna < spec.max_dna_bulges and 0 < i and not (wild[i - 1] and wild[i]) and j < len(text) and text[j] != "0":
                    walk(i, j + 1, columns + "D", mm, dna + 1, rna, start)
                if rna < spec.max_rna_bulges and not any(wild[max(0, i - 1) : i + 2]):
                    walk(i + 1, j, columns + "R", mm, dna, rna + 1, start)
                if j < len(text) and text[j] != "0":
                    g, p, f = code(text[j]), code(pattern[i]), code(spec.motif[i])
                    apart = not (p == 15 or (g != 15 and g & p))
                    if (f == 15 or (g != 15 and g & f)) and mm + apart <= spec.max_mismatches:
                        walk(i + 1, j + 1, columns + "M", mm + apart, dna, rna, start)

            out, kept = [], out
            for start in range(len(text)):
                walk(0, start, "", 0, 0, 0, start)
            for columns, start, j, mm, dna, rna in out:
                i, k, a, b = 0, start, "", ""
                for c in columns:
                    a += "-" if c == "D" else pattern[i]
                    b += "-" if c == "R" else text[k]
                    i, k = i + (c != "D"), k + (c != "R")
                at = start if forward else len(text) - j
                kind = "X" if not dna + rna else "DNA" if dna else "RNA"
                kept.append((kind, a, b, name, position(spec, at, forward, dna), "+" if forward else "-", mm, dna + rna))
            out = kept
    return out


def sites(genome, spec):
    find = bulge_sites if spec.max_dna_bulges or spec.max_rna_bulges else mismatch_sites
    return sorted(row for name, seq in genome for row in find(name, seq, spec))
