"""The scalar functions as SQL functions of a session.

Spark 4 SQL functions are inlined by the analyser, so they cost what the
expression costs and need no Python worker.
"""

SQL_FUNCTIONS = {
    "hash_rank": "(seed STRING, key STRING) RETURNS BIGINT RETURN cast(conv(substr(md5(concat_ws('|', seed, key)), 1, 8), 16, 10) AS BIGINT)",
    "hash_uniform": "(seed STRING, key STRING) RETURNS DOUBLE RETURN cast(conv(substr(md5(concat_ws('|', seed, key)), 1, 8), 16, 10) AS BIGINT) / 4294967296D",
    "half_even": "(x DOUBLE) RETURNS BIGINT RETURN cast(bround(x, 0) AS BIGINT)",
    "sat_u16": "(x DOUBLE) RETURNS INT RETURN cast(floor(least(greatest(x, 0D), 65535D)) AS INT)",
    "encode_prob_u8": "(p DOUBLE) RETURNS INT RETURN cast(floor(least(greatest(p * 255D + 0.5D, 0D), 255D)) AS INT)",
    "sigmoid": "(x DOUBLE) RETURNS DOUBLE RETURN 1D / (1D + exp(-x))",
    "sphere_section_radius": "(radius DOUBLE, dz DOUBLE) RETURNS DOUBLE RETURN CASE WHEN abs(dz) <= radius THEN sqrt(radius * radius - dz * dz) END",
    "flatten_index": "(z BIGINT, y BIGINT, x BIGINT, dim_y BIGINT, dim_x BIGINT) RETURNS BIGINT RETURN (z * dim_y + y) * dim_x + x",
    "box_volume": "(b ARRAY<BIGINT>) RETURNS BIGINT RETURN greatest(b[3] - b[0], 0) * greatest(b[4] - b[1], 0) * greatest(b[5] - b[2], 0)",
    "path_entity": "(path STRING, entity STRING) RETURNS STRING RETURN regexp_extract(path, concat('(?:^|[_/])', entity, '-([^_/.]+)'), 1)",
    "zero_pad": "(n BIGINT, width INT) RETURNS STRING RETURN lpad(cast(n AS STRING), greatest(length(cast(n AS STRING)), width), '0')",
    "dataset_short_name": "(name STRING) RETURNS STRING RETURN replace(coalesce(name, '?'), 'mouse_app_', '')",
    "vector_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "monitor_time": "(s STRING) RETURNS TIMESTAMP RETURN to_timestamp(s, 'yyyy-MM-dd HH:mm:ss')",
}


def register(spark, prefix="vox_"):
    """Create the functions as temporary functions of the session."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
    return [prefix + n for n in SQL_FUNCTIONS]
