"""Column functions: seeded hashing, rounding rules, arrays, names."""


from pyspark.sql import functions as F


def col(c):
    return F.col(c) if isinstance(c, str) else c


# --- seeded draws ---------------------------------------------------------
# A draw is a pure function of (seed, key), so it does not depend on the
# partitioning, can be recomputed after a lost executor, and has an SQL twin.

HASH_RANGE = 4294967296


def hash_rank(seed, *keys):
    """Uniform integer in [0, 2^32) from a seed and key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed, *keys):
    """Uniform double in [0, 1)."""
    return hash_rank(seed, *keys) / F.lit(float(HASH_RANGE))


def hash_between(seed, lo, hi, *keys):
    """Uniform integer in [lo, hi]."""
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return (lo + F.floor(hash_uniform(seed, *keys) * (hi - lo + 1))).cast("bigint")


def hash_range(seed, lo, hi, *keys):
    """Uniform double in [lo, hi)."""
    return F.lit(float(lo)) + hash_uniform(seed, *keys) * F.lit(float(hi) - float(lo))


# Modulus of the per-cell generator (the Mersenne prime 2^31 - 1).
CELL_MOD = 2147483647


def cell_hash(base, index):
    """Cheap non-linear mix of a per-patch hash and a cell index, in [0, 2^31-1).

    md5 per voxel would dominate a dense job; two modular squarings of
    64-bit integers are enough to decorrelate neighbouring cells.
    """
    mod = F.lit(CELL_MOD).cast("bigint")
    first = (base + index.cast("bigint") * F.lit(48271).cast("bigint")) % mod
    second = (first * first + base) % mod
    return (second * second + index.cast("bigint")) % mod


def normal_from_cells(h1, h2):
    """Standard normal draw from two cell hashes (Box-Muller)."""
    u1 = (h1 + F.lit(1.0)) / F.lit(float(CELL_MOD))
    u2 = h2 / F.lit(float(CELL_MOD))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def hash_normal(seed, *keys):
    """Standard normal draw per key."""
    u1 = (hash_rank(seed, *keys, F.lit("u1")) + F.lit(1.0)) / F.lit(float(HASH_RANGE))
    u2 = hash_uniform(seed, *keys, F.lit("u2"))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


# --- rounding and encoding ------------------------------------------------


def half_even(x):
    """Nearest integer, ties to even."""
    return F.bround(x, 0).cast("bigint")


def sat_u16(x):
    """Clamp to the range of an unsigned 16-bit value, dropping the fraction."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(65535.0))).cast("int")


def encode_prob_u8(p):
    """Probability to 0..255 with rounding half up and saturation."""
    return F.floor(F.least(F.greatest(p * 255.0 + 0.5, F.lit(0.0)), F.lit(255.0))).cast("int")


def binarize_u8(v, thr):
    """1 where an encoded probability is above the encoded threshold."""
    return (v > F.bround(F.lit(float(thr) * 255.0), 0)).cast("int")


def sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def sphere_section_radius(radius, dz):
    """Radius of the circle in which a plane at distance dz cuts a sphere."""
    return F.when(F.abs(dz) <= radius, F.sqrt(radius * radius - dz * dz))


# --- arrays ---------------------------------------------------------------


def let(value, body):
    """Evaluate ``value`` once per row and use it inside ``body``.

    The optimiser may copy a projected expression into a lambda, where it
    would run once per element; a lambda variable cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(a):
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b):
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(a, eps=1e-12):
    return let(
        F.greatest(norm(a), F.lit(eps)),
        lambda n: F.transform(a, lambda v: v.cast("double") / n),
    )


def cosine(a, b, eps=1e-8):
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def box_volume(box):
    """Voxels in a half-open box (z0, y0, x0, z1, y1, x1); 0 if inverted."""
    side = lambda i: F.greatest(F.get(box, F.lit(i + 3)) - F.get(box, F.lit(i)), F.lit(0)).cast("bigint")
    return side(0) * side(1) * side(2)


def box_intersect(a, b):
    """Intersection of two half-open boxes (may come out inverted)."""
    return F.array(
        *[F.greatest(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(3)],
        *[F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(3, 6)],
    )


def flatten_index(z, y, x, dy, dx):
    return (z * dy + y) * dx + x


def unflatten_index(i, dy, dx):
    """(z, y, x) columns of a flat C-order index."""
    i, dy, dx = (v if not isinstance(v, int) else F.lit(v) for v in (i, dy, dx))
    z = F.floor(i / (dy * dx)).cast("int")
    y = F.floor(F.pmod(i, dy * dx) / dx).cast("int")
    x = F.pmod(i, dx).cast("int")
    return z, y, x


# --- names ----------------------------------------------------------------


def entity(path, key):
    """Value of a ``key-value`` entity in a file name, '' if absent."""
    return F.regexp_extract(path, f"(?:^|[_/]){key}-([^_/.]+)", 1)


def file_name(path):
    return F.regexp_extract(path, "([^/]*)$", 1)


def strip_suffix(text, suffix):
    return F.when(
        text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))
    ).otherwise(text)


def clean_note(text):
    """One-line review note."""
    return F.replace(F.trim(text), F.lit("\n"), F.lit(" | "))


def zero_pad(number, width):
    """Decimal text of at least ``width`` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def numbered_id(*parts, number, width=3, at=1):
    """``parts`` joined by ``_`` with the padded ``number`` as part ``at``."""
    names = [p if not isinstance(p, str) else F.lit(p) for p in parts]
    names.insert(at, zero_pad(number, width))
    return F.concat_ws("_", *names)


# Fixed value: what the short name of a data set leaves out.
DATASET_PREFIX = "mouse_app_"


def dataset_short_name(name, prefix=DATASET_PREFIX):
    """The name without ``prefix``, wherever it stands; null counts as ``?``."""
    return F.replace(F.coalesce(name, F.lit("?")), F.lit(prefix), F.lit(""))
