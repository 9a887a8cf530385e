"""voxframe: volumetric patch data as Spark DataFrames."""
