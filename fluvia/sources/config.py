"""Configuration of a case and its basins: JSON documents in any store that Spark reads.

A case is one document, its basins a list of documents. Configuration is small and lives on the driver; what a run reads
and writes are tables.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Names and defaults that configuration files share.
CASE = {
    "iFlag_use_mesh_dem": 0, "iFlag_save_mesh": 1, "iFlag_simplification": 1, "iFlag_create_mesh": 1, "iFlag_intersect": 1, "iFlag_resample_method": 1,
    "iFlag_global": 0, "iFlag_multiple_outlet": 0, "iFlag_elevation_profile": 1, "iFlag_rotation": 0, "iFlag_stream_burning_topology": 1, "iFlag_save_elevation": 1,
    "nOutlet": 1, "dResolution_degree": 0.5, "dResolution_meter": 50000, "dLongitude_left": -180, "dLongitude_right": 180, "dLatitude_bot": -90, "dLatitude_top": 90,
    "sRegion": "susquehanna", "iCase_index": 1, "sMesh_type": "hexagon", "sDate": "20220202",
    "flowline_info": "flowline_info.json", "sFilename_mesh_info": "mesh_info.json", "sFilename_elevation": "elevation.json",
}
BASIN = {
    "iFlag_dam": 0, "iFlag_disconnected": 0, "lBasinID": 1, "dLatitude_outlet_degree": -180, "dLongitude_outlet_degree": 180, "dAccumulation_threshold": -90,
    "dThreshold_small_river": 90, "sFilename_dam": "ICoM_dams.csv", "sFilename_flowline_filter": "streamord7above.shp", "sFilename_flowline_raw": "allflowline.shp",
    "sFilename_flowline_topo": "flowline.csv", "sWorkspace_output_basin": "",
}
#: Of the mesher's settings only those of the spacing and of the mesh's kind: the mesher itself is not part of this engine.
SPACING = {
    "ncolumn_space": 360, "nrow_space": 180, "dSpac_value": 100.0, "iFlag_geom": False, "iFlag_spac": False, "iFlag_init": False, "iFlag_opts": False,
    "dResolution_land": 45.0, "dResolution_dam": 4.0, "dResolution_city": 4.0, "dResolution_river_network": 4.0, "dResolution_coastline": 4.0,
    "dResolution_watershed_boundary": 4.0, "dResolution_lake_boundary": 4.0, "geom_mshID": "ellipsoid-mesh", "spac_mshID": "ellipsoid-grid",
    "FULL_SPHERE_RADIUS": 6371.0, "dhdx_lim": 0.25, "hfun_hmax": "inf", "hfun_hmin": 0.0, "hfun_scal": "absolute", "mesh_dims": 2, "bisection": -1,
    "optm_qlim": 0.95, "optm_iter": 32, "optm_qtol": 1.0e-05,
}
TEMPLATES = {"case": CASE, "basin": BASIN, "spacing": SPACING}
MESH_TYPES = ("hexagon", "square", "latlon", "triangular", "mpas", "dggrid", "tin", "cubicsphere")


def template(kind: str, **values: Any) -> dict[str, Any]:
    """The defaults of a case, a basin or a spacing with ``values`` in their place; further keys are added."""
    return TEMPLATES[kind] | values


def basin_templates(count: int, **values: Any) -> list[dict[str, Any]]:
    """``count`` basins numbered from 1, each with an output folder of nine digits."""
    return [template("basin", **({"lBasinID": i, "sWorkspace_output_basin": f"{i:09d}"} | values)) for i in range(1, count + 1)]


def write_json(spark: SparkSession, value: Any, path: str) -> None:
    """One JSON document at ``path``; an old one is replaced only once the new one is whole."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(fresh)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{path} cannot be replaced")


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).where(F.length("value") > 0).first()[0])


def read_case(spark: SparkSession, path: str, **overrides: Any) -> dict[str, Any]:
    """The case at ``path``: an override counts before the file, the file before the defaults; overrides of None don't count.

    The mesh file may stand under either of its two names.
    """
    found = read_json(spark, path)
    if "sFilename_mesh_netcdf" in found:
        found.setdefault("sFilename_mpas_mesh_netcdf", found["sFilename_mesh_netcdf"])
    return CASE | found | {k: v for k, v in overrides.items() if v is not None} | {"sFilename_model_configuration": path}


def read_basins(spark: SparkSession, path: str, outlets: int | None = None) -> list[dict[str, Any]]:
    """The first ``outlets`` basins of the list at ``path`` (all without a number), with defaults for what is missing."""
    return [BASIN | b for b in read_json(spark, path)[:outlets]]


def edit_json(spark: SparkSession, path: str, changes: dict[str, Any], basin: int | None = None) -> None:
    """Change keys of the document at ``path``, or of its ``basin``-th one where it is a list."""
    found = read_json(spark, path)
    (found if basin is None else found[basin]).update(changes)
    write_json(spark, found, path)


def set_parameter(config: dict[str, Any], name: str, value: Any) -> dict[str, Any]:
    """The configuration with one value changed; the name must be known and the type that of the old value."""
    if name not in config:
        raise KeyError(f"unknown parameter {name}")
    if type(config[name]) is not type(value):
        raise TypeError(f"{name} is a {type(config[name]).__name__}, not a {type(value).__name__}")
    return config | {name: value}


def problems(case: dict[str, Any], basins: list[dict[str, Any]]) -> list[str]:
    """What keeps a case from being run; empty if nothing."""
    out = []
    if case["sMesh_type"] not in MESH_TYPES:
        out.append(f"unknown mesh type {case['sMesh_type']}")
    if case["dLongitude_left"] >= case["dLongitude_right"] or case["dLatitude_bot"] >= case["dLatitude_top"]:
        out.append("empty domain")
    if case["dResolution_meter"] <= 0 or case["dResolution_degree"] <= 0:
        out.append("resolution is not above 0")
    if not 1 <= case["nOutlet"] <= len(basins):
        out.append(f"{case['nOutlet']} outlets but {len(basins)} basins")
    for b in basins[: max(0, case["nOutlet"])]:
        if not (-90 <= b["dLatitude_outlet_degree"] <= 90 and -180 <= b["dLongitude_outlet_degree"] <= 180):
            out.append(f"basin {b['lBasinID']}: the outlet is not on the globe")
        if b["iFlag_dam"] and not (b["sFilename_dam"] and b["sFilename_flowline_topo"]):
            out.append(f"basin {b['lBasinID']}: dams without files")
    return out
