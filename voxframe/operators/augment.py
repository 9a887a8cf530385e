"""Seeded augmented copies of dense patches and their masks.

Every draw is a hash of (seed, step, patch keys, copy), so a copy can be made
again anywhere, and joins to its parameters. All steps are projections over
patch rows.
"""

from pyspark.sql import functions as F

from voxframe.functions.scalar import CELL_MOD, hash_between, hash_range, hash_rank, hash_uniform
from voxframe.operators import filters, kernels

# Ranges and probabilities of the presets.
NOISE = {"var": (0.0, 0.03), "p": 0.2}
LEGACY_NOISE = {"var": (0.0, 0.03), "p": 0.3}
BLUR = {"sigma": (0.1, 1.0), "p": 0.5}
JITTER = {"brightness": 0.1, "contrast": (0.75, 1.25), "p": 0.8}
PAIRED = {"brightness": 0.1, "contrast": (0.85, 1.15), "gamma": (0.8, 1.25), "noise_std": 0.03, "p": 0.8}
GAMMA = {"gamma": (0.7, 1.5), "p": 0.5}
LOW_RES = {"zoom": (0.5, 1.0), "p": 0.1, "p_channel": 0.5}
GRADIENT = {"strength": (-0.3, 0.3), "p": 0.2}
SECOND_VIEW_BLUR_P = 0.1


class Draws:
    """Named draws of one seed over the key columns of a copy."""

    def __init__(self, seed, keys):
        self.seed, self.keys = seed, list(keys)

    def chance(self, name, p):
        return hash_uniform(f"{self.seed}-{name}", *self.keys) <= F.lit(float(p))

    def uniform(self, name, lo, hi):
        return hash_range(f"{self.seed}-{name}", lo, hi, *self.keys)

    def integer(self, name, lo, hi):
        return hash_between(f"{self.seed}-{name}", lo, hi, *self.keys).cast("int")

    def base(self, name):
        return hash_rank(f"{self.seed}-{name}", *self.keys) % CELL_MOD


def copies(patches, n, name="copy"):
    return patches.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(int(n)))))


def _moves(draws, paired=False):
    flips = F.array(*[draws.chance(f"flip{a}", 0.5) for a in "zyx"])
    if paired:
        plane, turns = F.lit(2), draws.integer("turns", 0, 3)
    else:
        plane = draws.integer("plane", 0, 2)
        turns = F.when(draws.chance("rot", 0.5), draws.integer("turns", 1, 3)).otherwise(F.lit(0))
    return flips, plane, turns


def spatial_params(df, draws, paired=False):
    """Columns of the flips and the quarter turns of each copy."""
    return df.withColumns(dict(zip(("flips", "plane", "turns"), _moves(draws, paired))))


def _run(patches, *steps):
    """Dense rows after some steps, worked out together."""
    data = kernels.run_steps(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), steps)
    return kernels.pin(patches).withColumn("data", data)


def flip3d(patches, draws):
    return orient(patches, draws, turn=False)


def rot90_3d(patches, draws, paired=False):
    return orient(patches, draws, flip=False, paired=paired)


def orient_step(draws, flip=True, turn=True, paired=False):
    flips, plane, turns = _moves(draws, paired)
    return kernels.orient(flips if flip else F.array_repeat(F.lit(False), 3), plane, turns if turn else F.lit(0))


def orient(patches, draws, flip=True, turn=True, paired=False):
    """Random flips, then random quarter turns, of cubic dense patches."""
    return _run(patches, orient_step(draws, flip, turn, paired))


def orient_mask(mask, draws, n, flip=True, turn=True, paired=False):
    """The same movement of sparse voxels in an ``n``^3 patch."""
    df = spatial_params(mask, draws, paired)
    if flip:
        df = df.withColumns(
            {a: F.when(F.get("flips", F.lit(i)), F.lit(n - 1) - F.col(a)).otherwise(F.col(a)) for i, a in enumerate("zyx")}
        )
    if turn:
        first = F.when(F.col("plane") == 2, F.col("y")).otherwise(F.col("z"))
        second = F.when(F.col("plane") == 0, F.col("y")).otherwise(F.col("x"))
        a = F.when(F.col("turns") == 1, F.lit(n - 1) - second).when(F.col("turns") == 2, F.lit(n - 1) - first).when(
            F.col("turns") == 3, second
        ).otherwise(first)
        b = F.when(F.col("turns") == 1, first).when(F.col("turns") == 2, F.lit(n - 1) - second).when(
            F.col("turns") == 3, F.lit(n - 1) - first
        ).otherwise(second)
        df = df.withColumns({"_a": a, "_b": b}).withColumns(
            {
                "z": F.when(F.col("plane") == 2, F.col("z")).otherwise(F.col("_a")),
                "y": F.when(F.col("plane") == 0, F.col("_b")).when(F.col("plane") == 2, F.col("_a")).otherwise(F.col("y")),
                "x": F.when(F.col("plane") == 0, F.col("x")).otherwise(F.col("_b")),
            }
        ).drop("_a", "_b")
    return df.drop("flips", "plane", "turns")


def noise_step(apply, draws, std, clamp=False):
    return kernels.noise(apply, std, draws.base("noise1"), draws.base("noise2"), clamp)


def gaussian_noise_step(draws, cfg=NOISE, clamp=False):
    std = F.sqrt(draws.uniform("noise_var", *cfg["var"]))
    return noise_step(draws.chance("noise_p", cfg["p"]), draws, std, clamp)


def gaussian_noise(patches, draws, cfg=NOISE, clamp=False):
    """Additive noise with a drawn variance."""
    return _run(patches, gaussian_noise_step(draws, cfg, clamp))


def blur_step(draws, cfg=BLUR):
    taps = F.when(
        draws.chance("blur_p", cfg["p"]), filters.blur_taps(draws.uniform("blur_sigma", *cfg["sigma"]))
    ).otherwise(F.array().cast("array<double>"))
    return kernels.blur(taps)


def blur(patches, draws, cfg=BLUR):
    """Five-tap blur with a drawn sigma."""
    return _run(patches, blur_step(draws, cfg))


def jitter_step(draws, cfg=JITTER, clamp=False):
    shift = draws.uniform("brightness", -cfg["brightness"], cfg["brightness"])
    return kernels.jitter(draws.chance("jitter_p", cfg["p"]), shift, draws.uniform("contrast", *cfg["contrast"]), clamp)


def intensity_jitter(patches, draws, cfg=JITTER, clamp=False):
    """Brightness shift, then contrast around the shifted mean."""
    return _run(patches, jitter_step(draws, cfg, clamp))


def paired_jitter(patches, draws, cfg=PAIRED):
    """Image-only jitter of the paired set: four independent draws."""
    shift = draws.uniform("brightness", -cfg["brightness"], cfg["brightness"])
    contrast, none = draws.uniform("contrast", *cfg["contrast"]), F.lit(0.0)
    return _run(
        patches,
        kernels.jitter(draws.chance("bright_p", cfg["p"]), shift, F.lit(1.0)),
        kernels.jitter(draws.chance("contrast_p", cfg["p"]), none, contrast),
        kernels.gamma(draws.chance("gamma_p", 0.5), draws.uniform("gamma", *cfg["gamma"]), "signed"),
        noise_step(draws.chance("noise_p", 0.2), draws, F.lit(float(cfg["noise_std"]))),
    )


def gamma_step(draws, cfg=GAMMA, retain_stats=True, clamp=False):
    mode = "plain" if clamp else "keep" if retain_stats else "free"
    return kernels.gamma(draws.chance("gamma_p", cfg["p"]), draws.uniform("gamma", *cfg["gamma"]), mode)


def gamma(patches, draws, cfg=GAMMA, retain_stats=True, clamp=False):
    """Power of the values above the minimum; mean and sample sd are restored.

    ``clamp`` is the plain form for values in [0, 1]: no shift, no statistics.
    """
    return _run(patches, gamma_step(draws, cfg, retain_stats, clamp))


def low_resolution_step(draws, cfg=LOW_RES):
    zoom = draws.uniform("zoom", *cfg["zoom"])
    apply = draws.chance("low_p", cfg["p"]) & draws.chance("low_channel", cfg["p_channel"])
    # a copy that is not shrunk keeps its own size, where both steps are exact
    small = lambda d: F.when(apply, F.greatest(F.lit(1), F.bround(d * zoom, 0).cast("int"))).otherwise(d)
    return kernels.regrow(*(small(F.col(d)) for d in ("dz", "dy", "dx")))


def low_resolution(patches, draws, cfg=LOW_RES):
    """Nearest-neighbour shrink by a drawn zoom, then trilinear growth back."""
    return _run(patches, low_resolution_step(draws, cfg))


def gradient_step(draws, cfg=GRADIENT, clamp=False):
    strength, axis = draws.uniform("strength", *cfg["strength"]), draws.integer("axis", 0, 2)
    return kernels.ramp(draws.chance("gradient_p", cfg["p"]), strength, axis, clamp)


def brightness_gradient(patches, draws, cfg=GRADIENT, clamp=False):
    """Additive linear ramp from -strength to strength along a drawn axis."""
    return _run(patches, gradient_step(draws, cfg, clamp))


PRESETS = ("symmetric", "asymmetric", "legacy")


def augment(patches, keys, seed, preset="symmetric", view=1):
    """One view of every patch row with the fixed order of a preset.

    ``symmetric`` and ``asymmetric`` differ in the blur of the second view;
    ``legacy`` works on [0, 1], clamps after each intensity step and adds its
    noise last.
    """
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    d = Draws(f"{seed}-view{view}", keys)
    weak = view == 2 and preset != "symmetric"
    blur_cfg = {**BLUR, "p": SECOND_VIEW_BLUR_P} if weak else BLUR
    if preset == "legacy":
        return _run(
            patches,
            orient_step(d),
            jitter_step(d, clamp=True),
            gamma_step(d, clamp=True),
            blur_step(d, blur_cfg),
            gradient_step(d, clamp=True),
            gaussian_noise_step(d, LEGACY_NOISE, clamp=True),
            kernels.clip(0, 1),
        )
    return _run(
        patches, orient_step(d), gaussian_noise_step(d), blur_step(d, blur_cfg), jitter_step(d), gamma_step(d), low_resolution_step(d), gradient_step(d)
    )


def two_views(patches, keys, seed, preset="symmetric"):
    """Both views of every patch, marked by ``view``."""
    views = [augment(patches, keys, seed, preset, v).withColumn("view", F.lit(v)) for v in (1, 2)]
    return views[0].unionByName(views[1])
