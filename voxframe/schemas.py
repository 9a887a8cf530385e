"""Fixed schemas of the tables that come from files."""

from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


REGION_GROUPS = T.MapType(S, _struct(regions=T.ArrayType(S), weight=D))

CONFIG = _struct(
    dataset_roots=T.ArrayType(S),
    stain=S,
    region_groups=REGION_GROUPS,
    n_patches=L,
    patch_size=I,
    crop_size=I,
    seg_level=S,
    seed=L,
)

# Track-specific fields are nullable columns of one schema.
PATCH = _struct(
    patch_id=S,
    patch_no=L,
    track=S,
    roi=S,
    label=I,
    subject_id=S,
    dataset=S,
    dataset_root=S,
    zarr_path=S,
    zarr_source=S,
    stain_channel=I,
    center_phys=T.ArrayType(D),
    center_vox=T.ArrayType(D),
    center_vox_fullres=T.ArrayType(D),
    box_4um_zyx=T.ArrayType(I),
    box_fr_zyx=T.ArrayType(I),
    fullres_voxel_um_zyx=T.ArrayType(D),
    files=T.MapType(S, S),
)

MANIFEST = _struct(config=CONFIG, patches=T.ArrayType(PATCH))

PATCH_META = _struct(
    subject_id=S,
    dataset=S,
    region_group=S,
    center_phys=T.ArrayType(D),
    center_vox=T.ArrayType(D),
    wt_references=T.ArrayType(S),
    wt_fallback_count=I,
    mu_wt=D,
    sigma_wt=D,
    n_components_otsu2=I,
    n_components_otsu3=I,
    _corrupt=S,
)

LABEL_TABLE = _struct(index=I, name=S, abbreviation=S)
CENTROIDS = _struct(x=I, y=I, z=I)

_ZYX = _struct(z=D, y=D, x=D)
SIDECAR = _struct(
    fullres_to_resampled=_struct(scale=_ZYX),
    source=_struct(path=S, voxel_sizes_um=_ZYX, shape_czyx=T.ArrayType(L)),
)

_TRANSFORM = _struct(type=S, scale=T.ArrayType(D), translation=T.ArrayType(D))
_AXIS = _struct(name=S, type=S, unit=S)
MULTISCALES = T.ArrayType(
    _struct(
        name=S,
        axes=T.ArrayType(_AXIS),
        datasets=T.ArrayType(_struct(path=S, coordinateTransformations=T.ArrayType(_TRANSFORM))),
    )
)
_OMERO = _struct(channels=T.ArrayType(_struct(label=S)))
META_V04 = _struct(multiscales=MULTISCALES, omero=_OMERO, xyz_orientation=S)
META_V05 = _struct(
    attributes=_struct(ome=_struct(version=S, multiscales=MULTISCALES, omero=_OMERO), xyz_orientation=S)
)
ARRAY_META = _struct(shape=T.ArrayType(L))

MONITOR = T.StructType(
    [T.StructField("timestamp", S)]
    + [
        T.StructField(n, D)
        for n in (
            "gpu0_util_pct gpu0_mem_mb gpu0_power_w gpu1_util_pct gpu1_mem_mb gpu1_power_w cpu_load_1m cpu_load_5m "
            "cpu_load_15m mem_used_gb mem_available_gb mem_buff_cache_gb train_epoch train_step train_loss train_lr "
            "epoch_progress_pct"
        ).split()
    ]
)
