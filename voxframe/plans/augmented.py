"""Queries that write seeded augmented copies."""

from pyspark.sql import functions as F

from voxframe.operators import augment, dense
from voxframe.operators.augment import Draws
from voxframe.plans.keys import sql_rank
from voxframe.plans.registry import query
from voxframe.plans.spatial import volumes

KEYS = ["volume_id", "copy"]
SEED = 17
START = "st as (select volume_id, c.copy, z, y, x, value / 47e0 as value from D, (select cast(unnest([1, 2]) as int) as copy) c)"


def start(s):
    df = volumes(s).withColumn("data", F.transform("data", lambda v: v / 47.0))
    return augment.copies(df, 2)


def out(df):
    return dense.to_voxels(df, KEYS).withColumn("value", F.round("value", 6))


class Sql:
    """Builds the same steps as a chain of common table expressions."""

    def __init__(self, seed):
        self.seed, self.ctes, self.last, self.n = seed, [START], "st", 0

    def u(self, name):
        return f"({sql_rank(f'{self.seed}-{name}', 'volume_id', 'copy')} / 4294967296e0)"

    def uniform(self, name, lo, hi):
        return f"({float(lo)!r}::double + {self.u(name)} * {float(hi) - float(lo)!r}::double)"

    def integer(self, name, lo, hi):
        return f"cast({lo} + floor({self.u(name)} * ({hi} - {lo} + 1)) as int)"

    def chance(self, name, p):
        return f"({self.u(name)} <= {float(p)!r}::double)"

    def add(self, text, name="s"):
        self.n += 1
        label = f"{name}{self.n}"
        self.ctes.append(f"{label} as materialized ({text})")
        return label

    def params(self, columns):
        """One row of draws per copy."""
        cols = ", ".join(f"{v} as {k}" for k, v in columns.items())
        return self.add(f"select volume_id, copy, {cols} from (select distinct volume_id, copy from st)", "p")

    def pointwise(self, columns, expr, extra=""):
        p = self.params(columns)
        self.last = self.add(f"select t.volume_id, t.copy, z, y, x, {expr} as value from {self.last} t join {p} p using (volume_id, copy) {extra}")
        return self

    def orient(self, flip=True, turn=True, paired=False):
        turns = self.integer("turns", 0, 3) if paired else f"case when {self.chance('rot', 0.5)} then {self.integer('turns', 1, 3)} else 0 end"
        p = self.params({**{f"f{a}": self.chance(f"flip{a}", 0.5) for a in "zyx"}, "plane": "2" if paired else self.integer("plane", 0, 2), "k": turns})
        cur = self.last
        if flip:
            cur = self.add(f"select t.volume_id, t.copy, {', '.join(f'case when f{a} then 11 - {a} else {a} end as {a}' for a in 'zyx')}, value from {cur} t join {p} p using (volume_id, copy)")
        if turn:
            a, b = "(case when plane = 2 then y else z end)", "(case when plane = 0 then y else x end)"
            na = f"(case k when 1 then 11 - {b} when 2 then 11 - {a} when 3 then {b} else {a} end)"
            nb = f"(case k when 1 then {a} when 2 then 11 - {b} when 3 then 11 - {a} else {b} end)"
            cur = self.add(f"select t.volume_id, t.copy, case when plane = 2 then z else {na} end as z, case plane when 0 then {nb} when 2 then {na} else y end as y, case when plane = 0 then x else {nb} end as x, value from {cur} t join {p} p using (volume_id, copy)")
        self.last = cur
        return self

    def noise(self, apply, std, clamp=False):
        base = lambda n: f"({sql_rank(f'{self.seed}-noise{n}', 'volume_id', 'copy')} % 2147483647)"
        i = "cast(z * 144 + y * 12 + x as bigint)"
        p = self.params({"ap": apply, "sd": std, "b1": base(1), "b2": base(2)})
        h = self.add(f"select t.*, ap, sd, b1, b2, (b1 + {i} * 48271) % 2147483647 as q1, (b2 + {i} * 48271) % 2147483647 as q2 from {self.last} t join {p} p using (volume_id, copy)")
        h = self.add(f"select *, (q1 * q1 + b1) % 2147483647 as r1, (q2 * q2 + b2) % 2147483647 as r2 from {h}")
        v = f"value + sd * sqrt(-2e0 * ln(((r1 * r1 + {i}) % 2147483647 + 1e0) / 2147483647e0)) * cos(6.283185307179586e0 * (((r2 * r2 + {i}) % 2147483647) / 2147483647e0))"
        if clamp:
            v = f"least(greatest({v}, 0e0), 1e0)"
        self.last = self.add(f"select volume_id, copy, z, y, x, case when ap then {v} else value end as value from {h}")
        return self

    def blur(self, p):
        sg = self.uniform("blur_sigma", 0.1, 1.0)
        par = self.params({"ap": self.chance("blur_p", p), "e1": f"exp(-5e-1 / ({sg} * {sg}))", "e2": f"exp(-2e0 / ({sg} * {sg}))"})
        k = self.add(f"select volume_id, copy, k, case when not ap then (case when k = 0 then 1e0 else 0e0 end) else (case abs(k) when 0 then 1e0 when 1 then e1 else e2 end) / (1 + 2 * e1 + 2 * e2) end as w from {par}, (select unnest(range(-2, 3)) as k)", "k")
        for a in "zyx":
            others = ", ".join(b for b in "zyx" if b != a)
            # every output reads five inputs with the index clamped to the edge
            self.last = self.add(
                f"select o.volume_id, o.copy, {', '.join('o.' + b for b in 'zyx')}, sum(k.w * i.value) as value from {self.last} o join {k} k on k.volume_id = o.volume_id and k.copy = o.copy "
                f"join {self.last} i on i.volume_id = o.volume_id and i.copy = o.copy and {' and '.join(f'i.{b} = o.{b}' for b in 'zyx' if b != a)} and i.{a} = greatest(0, least(11, o.{a} + k.k)) group by 1, 2, 3, 4, 5"
            )
        return self

    def stats(self, sample=False):
        return self.add(f"select volume_id, copy, avg(value) as m, stddev_samp(value) + 1e-8 as sd, min(value) as lo from {self.last} group by 1, 2", "m")

    def jitter(self, cfg, clamp=False):
        m = self.stats()
        v = "(value - m) * c + m + b"
        if clamp:
            v = f"least(greatest({v}, 0e0), 1e0)"
        return self.pointwise(
            {"ap": self.chance("jitter_p", cfg["p"]), "b": self.uniform("brightness", -cfg["brightness"], cfg["brightness"]), "c": self.uniform("contrast", *cfg["contrast"])},
            f"case when ap then {v} else value end", f"join {m} using (volume_id, copy)")

    def gamma(self, cfg, clamp=False):
        draws = {"ap": self.chance("gamma_p", cfg["p"]), "g": self.uniform("gamma", *cfg["gamma"])}
        if clamp:
            return self.pointwise(draws, "case when ap then least(greatest(pow(greatest(value, 1e-8), g), 0e0), 1e0) else value end")
        was = self.stats()
        before = self.last
        self.pointwise(draws, "pow(greatest(value - lo, 1e-8), g)", f"join {was} using (volume_id, copy)")
        now = self.stats()
        powered = self.last
        p = self.params({"ap": draws["ap"]})
        self.last = self.add(
            f"select o.volume_id, o.copy, o.z, o.y, o.x, case when ap then (w.value - n.m) / n.sd * b.sd + b.m else o.value end as value from {before} o join {powered} w using (volume_id, copy, z, y, x) "
            f"join {was} b using (volume_id, copy) join {now} n using (volume_id, copy) join {p} p using (volume_id, copy)")
        return self

    def low_res(self, cfg):
        zoom = self.uniform("zoom", *cfg["zoom"])
        par = self.params({"n": f"case when {self.chance('low_p', cfg['p'])} and {self.chance('low_channel', cfg['p_channel'])} then greatest(1, cast(round_even(12 * {zoom}, 0) as int)) else 12 end"})
        ax = self.add(f"select volume_id, copy, o, lo, least(lo + 1, n - 1) as hi, c - lo as t, n from (select *, cast(floor(c) as int) as lo from (select volume_id, copy, n, cast(o as int) as o, greatest((o + 5e-1) * (n / 12) - 5e-1, 0e0) as c from {par}, (select unnest(range(12)) as o)))", "a")
        for a in "zyx":
            pick = lambda alias: f"{alias}.volume_id = ax.volume_id and {alias}.copy = ax.copy"
            rest = [b for b in "zyx" if b != a]
            self.last = self.add(
                f"select l.volume_id, l.copy, ax.o as {a}, {', '.join('l.' + b for b in rest)}, l.value * (1 - t) + h.value * t as value from {ax} ax join {self.last} l on {pick('l')} and l.{a} = cast(floor(lo * 12 / n) as int) "
                f"join {self.last} h on {pick('h')} and h.{a} = cast(floor(hi * 12 / n) as int) and {' and '.join(f'h.{b} = l.{b}' for b in rest)}")
        return self

    def gradient(self, cfg, clamp=False):
        v = "value - s + s * 2 * (case axis when 0 then z when 1 then y else x end) / 11"
        if clamp:
            v = f"least(greatest({v}, 0e0), 1e0)"
        return self.pointwise({"ap": self.chance("gradient_p", cfg["p"]), "s": self.uniform("strength", *cfg["strength"]), "axis": self.integer("axis", 0, 2)}, f"case when ap then {v} else value end")

    def paired(self, cfg):
        self.pointwise({"ap": self.chance("bright_p", cfg["p"]), "b": self.uniform("brightness", -cfg["brightness"], cfg["brightness"])}, "case when ap then value + b else value end")
        m = self.stats()
        self.pointwise({"ap": self.chance("contrast_p", cfg["p"]), "c": self.uniform("contrast", *cfg["contrast"])}, "case when ap then (value - m) * c + m else value end", f"join {m} using (volume_id, copy)")
        self.pointwise({"ap": self.chance("gamma_p", 0.5), "g": self.uniform("gamma", *cfg["gamma"])}, "case when ap then sign(value) * pow(greatest(abs(value), 1e-6), g) else value end")
        return self.noise(self.chance("noise_p", 0.2), repr(cfg["noise_std"]) + "::double")

    def text(self):
        return f"with {', '.join(self.ctes)} select volume_id, copy, cast(z as int) as z, cast(y as int) as y, cast(x as int) as x, round(value, 6) as value from {self.last}"


def sql():
    return Sql(SEED)


def noise_sql(q, cfg, clamp=False):
    return q.noise(q.chance("noise_p", cfg["p"]), f"sqrt({q.uniform('noise_var', *cfg['var'])})", clamp)


def draws():
    return Draws(SEED, KEYS)


@query("flip3d", "D", sql().orient(turn=False).text())
def flip3d(s):
    return out(augment.flip3d(start(s), draws()))


@query("rot90_3d", "D", sql().orient(flip=False).text())
def rot90_3d(s):
    return out(augment.rot90_3d(start(s), draws()))


MASK_START = "st as (select volume_id, c.copy, z, y, x, 1e0 as value from M, (select cast(unnest([1, 2]) as int) as copy) c)"


@query("orient_mask", "M", sql().orient(paired=True).text().replace(START, MASK_START))
def orient_mask(s):
    mask = augment.copies(s.M, 2)
    return augment.orient_mask(mask, draws(), 12, paired=True).select(*KEYS, "z", "y", "x", F.lit(1.0).alias("value"))


@query("gaussian_noise", "D", noise_sql(sql(), augment.NOISE).text())
def gaussian_noise(s):
    return out(augment.gaussian_noise(start(s), draws()))


@query("random_blur", "D", sql().blur(0.5).text())
def random_blur(s):
    return out(augment.blur(start(s), draws()))


@query("intensity_jitter", "D", sql().jitter(augment.JITTER).text())
def intensity_jitter(s):
    return out(augment.intensity_jitter(start(s), draws()))


@query("paired_jitter", "D", sql().paired(augment.PAIRED).text())
def paired_jitter(s):
    return out(augment.paired_jitter(start(s), draws()))


@query("gamma", "D", sql().gamma(augment.GAMMA).text())
def gamma(s):
    return out(augment.gamma(start(s), draws()))


@query("low_resolution", "D", sql().low_res({**augment.LOW_RES, "p": 0.9}).text())
def low_resolution(s):
    return out(augment.low_resolution(start(s), draws(), {**augment.LOW_RES, "p": 0.9}))


@query("brightness_gradient", "D", sql().gradient(augment.GRADIENT).text())
def brightness_gradient(s):
    return out(augment.brightness_gradient(start(s), draws()))


def preset_sql(preset, view):
    q = Sql(f"{SEED}-view{view}")
    weak = view == 2 and preset != "symmetric"
    p = augment.SECOND_VIEW_BLUR_P if weak else 0.5
    q.orient()
    if preset == "legacy":
        q.jitter(augment.JITTER, True).gamma(augment.GAMMA, True).blur(p).gradient(augment.GRADIENT, True)
        noise_sql(q, augment.LEGACY_NOISE, True)
        return q.text().replace("round(value, 6)", "round(least(greatest(value, 0e0), 1e0), 6)")
    noise_sql(q, augment.NOISE)
    return q.blur(p).jitter(augment.JITTER).gamma(augment.GAMMA).low_res(augment.LOW_RES).gradient(augment.GRADIENT).text()


@query("augment_symmetric", "D", preset_sql("symmetric", 1))
def augment_symmetric(s):
    return out(augment.augment(start(s), KEYS, SEED, "symmetric", 1))


@query("augment_asymmetric", "D", preset_sql("asymmetric", 2))
def augment_asymmetric(s):
    return out(augment.augment(start(s), KEYS, SEED, "asymmetric", 2))


@query("augment_legacy", "D", preset_sql("legacy", 2))
def augment_legacy(s):
    return out(augment.augment(start(s), KEYS, SEED, "legacy", 2))
