"""Recipes: named operators with parameters, read from YAML, bound into one lazy plan over a namespace of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from photonflow.functions.expr import with_mappings
from photonflow.operators import aggregates, camera, clumping, emitters, flow, images, kernels, localise, registration, shells, spatial, tables, vectors, volumes, windows
from photonflow.sources.tabular import read_table, write_table


@dataclass(frozen=True)
class Operator:
    """inputs: parameter names that hold table names; run takes the tables and the other parameters. Inputs named in `optional` may be left out (None).

    output: the parameter that names the result, or several for an operator of several results, in order; results that are not named are not kept.
    """

    inputs: tuple[str, ...]
    run: Callable[..., DataFrame | tuple[DataFrame, ...]]
    output: str | tuple[str, ...] = "outputName"
    optional: tuple[str, ...] = ()


OPERATORS: dict[str, Operator] = {}
#: Older names of operators.
LEGACY = {"tablefilters.FilterTable": "FilterTable", "tablefilters.Mapping": "Mapping", "localisations.MergeClumps": "MergeClumps"}


def operator(name: str, *inputs: str, output: str | tuple[str, ...] = "outputName", optional: tuple[str, ...] = ()):
    def add(f: Callable[..., Any]) -> Callable[..., Any]:
        OPERATORS[name] = Operator((*inputs, *optional), f, output, optional)
        return f

    return add


@operator("Mapping", "inputName")
def _mapping(df: DataFrame, mappings: Mapping[str, str], order: list[str] = ()) -> DataFrame:
    """order: columns that name each row, for cumsum and diff."""
    return with_mappings(df, mappings, order=order)


@operator("FilterTable", "inputName")
def _filter(df: DataFrame, filters: Mapping[str, list]) -> DataFrame:
    return tables.filter_table(df, filters)


@operator("FilterTableByIDs", "inputName")
def _by_ids(df: DataFrame, ids: list[int], idColumnName: str = "clumpID") -> DataFrame:
    return tables.filter_by_ids(df, idColumnName, ids)


@operator("SelectTableColumns", "inputMeasurements")
def _select(df: DataFrame, keys: str) -> DataFrame:
    return tables.select_columns(df, keys)


@operator("ConcatenateTables", "inputName0", "inputName1")
def _concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    return tables.concatenate(a, b)


@operator("RandomSubset", "input", output="output")
def _subset(df: DataFrame, num_to_select: int = 100, strict: bool = False) -> DataFrame:
    return tables.random_subset(df, num_to_select, strict)


@operator("AddMeasurementsByLabel", "input_points", "input_measurements", output="output_points")
def _measurements(points: DataFrame, measurements: DataFrame, label_key: str = "label") -> DataFrame:
    return tables.add_measurements_by_label(points, measurements, label_key)


@operator("TimeBlocks", "input", output="output")
def _blocks(df: DataFrame, block_size: int = 100) -> DataFrame:
    return tables.time_blocks(df, block_size)


@operator("MergeClumps", "inputName")
def _merge(df: DataFrame, labelKey: str = "clumpIndex", discardTrivial: bool = False) -> DataFrame:
    return aggregates.merge_clumps(df, labelKey, discardTrivial)


@operator("FindClumps", "inputName")
def _clumps(df: DataFrame, timeWindow: int = 3, clumpRadiusScale: float = 2.0, clumpRadiusVariable: str = "error_x", seriesKey: str = "series", rowKey: str = "row_id") -> DataFrame:
    scaled = with_mappings(df, {"_radius": f"{clumpRadiusScale} * {clumpRadiusVariable}"})
    return windows.clump_size(clumping.find_clumps(scaled, seriesKey, "t", "x", "y", "_radius", timeWindow, rowKey).drop("_radius"), "clumpIndex")


@operator("DBSCANClustering", "inputName")
def _dbscan(df: DataFrame, columns: list[str] = ("x", "y", "z"), searchRadius: float = 10, minClumpSize: int = 1, rowKey: str = "row_id") -> DataFrame:
    return clumping.dbscan(df, columns, searchRadius, minClumpSize, rowKey)


@operator("MeasureClusters3D", "inputName")
def _clusters(df: DataFrame, labelKey: str = "clumpIndex") -> DataFrame:
    return clumping.measure_clusters(df, labelKey)


@operator("AggregateMeasurements", "inputMeasurements1", "inputMeasurements2")
def _side_by_side(a: DataFrame, b: DataFrame, suffix1: str = "", suffix2: str = "", rowKey: str = "row_id") -> DataFrame:
    return tables.aggregate_positional([a, b], [suffix1, suffix2], rowKey)


@operator("ExtractTableChannel", "inputName")
def _channel(df: DataFrame, channel: str = "everything") -> DataFrame:
    return tables.colour_filter(df, channel, [c[2:] for c in df.columns if c.startswith("p_")])


@operator("ProcessColour", "input", output="output")
def _colour(df: DataFrame, species_ratios: Mapping[str, float]) -> DataFrame:
    return tables.species_probabilities(df, species_ratios)


@operator("Fold", "input_name", output="output_name")
def _fold(df: DataFrame, roi: float, views: int) -> DataFrame:
    return tables.fold(df, "x", roi, views)


@operator("Histogram", "inputMeasurements")
def _histogram(df: DataFrame, key: str, nbins: int = 50, left: float = 0.0, right: float = 1000.0, normalize: bool = False) -> DataFrame:
    return aggregates.histogram(df, F.col(key), nbins, left, right, normalize)


@operator("ClusterCountVsImagingTime", "inputName")
def _counts(df: DataFrame, stop: int, labelsKey: str = "dbscanClumpID", lowerMinPtsPerCluster: int = 3, higherMinPtsPerCluster: int = 6, stepSize: int = 3000) -> DataFrame:
    return aggregates.cluster_count_vs_time(df, labelsKey, "t", lowerMinPtsPerCluster, higherMinPtsPerCluster, stepSize, stop)


@operator("PairwiseDistanceHistogram", "inputPositions")
def _pairs(df: DataFrame, nbins: int = 50, binSize: float = 50.0, columns: list[str] = ("x", "y", "z"), rowKey: str = "row_id") -> DataFrame:
    return spatial.pair_histogram(df, columns, nbins, binSize, rowKey)


@operator("NearestNeighbourDistances", "inputChan0", "inputChan1")
def _nearest(a: DataFrame, b: DataFrame, columns: list[str] = ("x", "y"), start: float = 100.0, rowKey: str = "row_id") -> DataFrame:
    return spatial.nearest(b, a, columns, start, rowKey)


@operator("Ripleys", "inputPositions")
def _ripley(df: DataFrame, area: float, nbins: int = 50, binSize: float = 50.0, columns: list[str] = ("x", "y"), rowKey: str = "row_id") -> DataFrame:
    return spatial.ripley(df, columns, nbins, binSize, rowKey, area)


@operator("LocalPointDensity", "input", output="output")
def _density(df: DataFrame, radius: float, n_nearest_neighbours: int = 10, columns: list[str] = ("x", "y", "z"), rowKey: str = "row_id") -> DataFrame:
    return spatial.local_density(df, columns, n_nearest_neighbours, radius, rowKey)


@operator("DensityMapping", "inputLocalizations", output="outputImage")
def _render(df: DataFrame, pixelSize: float = 5.0, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    return spatial.render_histogram(df, F.col("x"), F.col("y"), x0, y0, pixelSize)


@operator("IdentifyOverlappingROIs", "input", output="output")
def _overlaps(df: DataFrame, distance: float, reject_key: str = "rejected", rowKey: str = "row_id") -> DataFrame:
    return clumping.overlap_rejection(df, ("x", "y"), distance, rowKey, reject_key)


@operator("TrackFeatures", "inputMeasurements", output="outputTrackInfo")
def _track(df: DataFrame, features: str = "x,y", pNew: float = 0.2, r0: float = 500.0, pLinkCutoff: float = 0.2, seriesKey: str = "series", rowKey: str = "row_id") -> DataFrame:
    return clumping.track_frames(df, seriesKey, "t", features.replace(" ", "").split(","), rowKey, pNew, r0, pLinkCutoff)


def _frame_operator(name: str, make: Callable[..., kernels.Kernel]) -> None:
    operator(name, "inputName")(lambda df, **params: images.frame_filter(df, make(**params)))


for _name, _make in {
    "GaussianFilter": lambda sigmaX=1.0: images.gaussian(sigmaX),
    "MedianFilter": lambda sizeX=3, sizeY=3: kernels.neighbourhood(kernels.np.median, sizeY, sizeX),
    "MaxFilter": lambda sizeX=3, sizeY=3: kernels.neighbourhood(kernels.np.max, sizeY, sizeX),
    "MinFilter": lambda sizeX=3, sizeY=3: kernels.neighbourhood(kernels.np.min, sizeY, sizeX),
    "MeanFilter": lambda sizeX=3, sizeY=3: kernels.neighbourhood(kernels.np.mean, sizeY, sizeX),
    "DespeckleFilter": lambda sizeX=3, nPix=3: kernels.despeckle(sizeX, nPix),
    "DoGFilter": lambda sigmaX=1.0, sigma2X=2.0: kernels.difference_of_gaussians(sigmaX, sigma2X),
    "MaskEdges": lambda widthPixels=10: kernels.mask_edges(widthPixels),
    "FractionalThreshold": lambda fractionThreshold=0.5: kernels.threshold_by(lambda image: kernels.fractional_level(image, fractionThreshold)),
    "Threshold": lambda method="isodata": kernels.threshold_by({"isodata": kernels.isodata_level, "otsu": kernels.otsu_level}[method]),
    "Label": lambda minRegionPixels=10: kernels.label_regions(minRegionPixels),
    "SelectLargestLabel": lambda: kernels.largest_label,
    "LocalMaxima": lambda threshold=0.3, minDistance=10: kernels.local_maxima(threshold, minDistance),
    "DistanceTransform": lambda: kernels.distance_transform,
    "BinaryDilation": lambda radius=1.0, iterations=1: kernels.binary_morphology(True, radius, iterations),
    "BinaryErosion": lambda radius=1.0, iterations=1: kernels.binary_morphology(False, radius, iterations),
    "BinaryFillHoles": lambda: kernels.fill_holes,
    "GreyDilation": lambda radius=1.0: kernels.grey_morphology(kernels.np.max, radius),
    "GreyErosion": lambda radius=1.0: kernels.grey_morphology(kernels.np.min, radius),
    "WhiteTophat": lambda radius=1.0: kernels.white_tophat(radius),
}.items():
    _frame_operator(_name, _make)


@operator("SimpleThreshold", "inputName")
def _threshold(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return images.threshold(df, threshold)


@operator("Normalize", "inputName")
def _normalise(df: DataFrame) -> DataFrame:
    return images.normalise(df)


@operator("Rotate180", "inputName")
def _rotate(df: DataFrame) -> DataFrame:
    return images.rotate180(df)


@operator("Crop", "input", output="output")
def _crop(df: DataFrame, x_range: list[int] = (0, -1), y_range: list[int] = (0, -1)) -> DataFrame:
    return images.crop(df, tuple(y_range), tuple(x_range))


#: What tells frames apart where two images are combined.
FRAME_KEYS = ("series", "c", "z", "t")


def _keys(a: DataFrame, b: DataFrame) -> list[str]:
    return [k for k in FRAME_KEYS if k in a.columns and k in b.columns]


def _two_images(name: str, make: Callable[..., Callable], inputs: tuple[str, str] = ("inputName0", "inputName1")) -> None:
    operator(name, *inputs)(lambda a, b, **params: images.combine(a, b, _keys(a, b), make(**params)))


def _one_image(name: str, make: Callable[..., Callable], *inputs: str) -> None:
    operator(name, *(inputs or ("inputName",)))(lambda df, **params: images.pixel_map(df, make(**params)))


def _mark(c):
    return c.cast("double")


for _name, _two in {
    "Add": lambda: lambda a, b: a + b,
    "Subtract": lambda: lambda a, b: a - b,
    "Multiply": lambda: lambda a, b: a * b,
    "Divide": lambda: F.try_divide,
    "BinaryOr": lambda: lambda a, b: _mark(a + b > 0.5),
    "LogicalAnd": lambda: lambda a, b: _mark((a != 0) & (b != 0)),
    "IsClose": lambda abs_tolerance=1e-8, rel_tolerance=1e-5: lambda a, b: _mark(F.abs(a - b) <= abs_tolerance + rel_tolerance * F.abs(b)),
}.items():
    _two_images(_name, _two)

for _name, _one in {
    "Scale": lambda scale=1.0: lambda p: p * scale,
    "Offset": lambda offset=0.0: lambda p: p + offset,
    "Pow": lambda power=2.0: lambda p: F.pow(p, F.lit(float(power))),
    "Clip": lambda min=0.0, max=3.4e38: lambda p: F.least(F.greatest(p, F.lit(float(min))), F.lit(float(max))),
    "Invert": lambda: lambda p: 1.0 - p,
    "SelectLabel": lambda label=1: lambda p: _mark(p == label),
}.items():
    _one_image(_name, _one)


@operator("NormalizeMean", "inputName")
def _normalise_mean(df: DataFrame, offset: float = 0.0) -> DataFrame:
    return images.normalise_mean(df, offset)


@operator("Zoom", "inputName")
def _zoom(df: DataFrame, zoom: float = 1.0) -> DataFrame:
    return images.zoom(df, zoom)


@operator("JoinChannels", "inputChan0", "inputChan1")
def _join_channels(a: DataFrame, b: DataFrame) -> DataFrame:
    return images.join_channels([a, b])


@operator("Gradient2D", "inputName", output=("outputNameX", "outputNameY"))
def _gradient(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(df.withColumn("pixels", vectors.gradient(F.col("pixels"), F.col("width"), across)) for across in (True, False))


def _volume_keys(df: DataFrame) -> list[str]:
    return [k for k in FRAME_KEYS if k in df.columns and k != "z"]


@operator("Gradient3D", "inputName", output=("outputNameX", "outputNameY", "outputNameZ"))
def _gradient3d(df: DataFrame, units: str = "intensity/pixel", voxelsize: list[float] = (1000.0, 1000.0, 1000.0)) -> tuple[DataFrame, ...]:
    """voxelsize (nm) counts where units are intensity/um."""
    size = [v / 1e3 for v in voxelsize] if units == "intensity/um" else (1.0, 1.0, 1.0)
    found = volumes.gradient3d(df, _volume_keys(df), size)
    return tuple(found.withColumn("pixels", F.col(f"grad_{c}")).drop("grad_x", "grad_y", "grad_z") for c in "xyz")


@operator("OpticalFlow", "inputName", output=("outputNameX", "outputNameY"))
def _flow(df: DataFrame, filterRadius: float = 1.0, supportRadius: float = 10.0, regularizationLambda: float = 0.0, seriesKey: str = "series") -> tuple[DataFrame, DataFrame]:
    found = flow.optical_flow(df, seriesKey, "t", filterRadius, supportRadius, regularizationLambda)
    return tuple(found.withColumn("pixels", F.col(f"flow_{c}")).drop("flow_x", "flow_y") for c in "xy")


@operator("Watershed", "inputImage", "inputMarkers", optional=("inputMask",))
def _watershed(df: DataFrame, markers: DataFrame, mask: DataFrame | None) -> DataFrame:
    return flow.watershed(df, markers, _keys(df, markers), mask)


@operator("ColocalisationEDT", "inputImage", "inputMask", output="outputTable", optional=("inputImageB", "inputRoiMask"))
def _coloc_edt(df: DataFrame, mask: DataFrame, other: DataFrame | None, roi: DataFrame | None, minimumDistanceNM: float = -500.0, maximumDistanceNM: float = 2000.0, binSizeNM: float = 100.0, voxelsize: list[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    keys = [k for k in _volume_keys(df) if k in mask.columns]
    stripes = volumes.feature_transform(mask, keys, voxelsize)
    told = lambda image: volumes.distance_colocalisation(image, stripes, keys, minimumDistanceNM, binSizeNM, maximumDistanceNM, roi)
    if other is None:
        return told(df)
    return told(df).join(told(other).select(*keys, "bins", F.col("enrichment").alias("enrichment_m"), F.col("enclosed").alias("enclosed_m")), [*keys, "bins"])


@operator("CalibrateShifts", "input_name", output="output_name")
def _calibrate(df: DataFrame, search_radius_nm: float = 250.0, clump: str = "clumpIndex", channel: str = "multiviewChannel") -> DataFrame:
    return registration.calibrate_shifts(df, channel, clump, ("x", "y"), search_radius_nm)


@operator("ShiftCorrect", "input_name", "shift_map", output="output_name")
def _shift(df: DataFrame, shifts: DataFrame, channel: str = "multiviewChannel") -> DataFrame:
    return registration.shift_correct(df, shifts, channel)


@operator("FindClumpsWithinChannel", "input_name", output="output_name")
def _channel_clumps(df: DataFrame, time_gap_tolerance: int = 1, radius_scale: float = 2.0, radius_offset_nm: float = 0.0, probe: str = "probe", rowKey: str = "row_id") -> DataFrame:
    near = df.withColumn("_radius", F.col("error_x") * radius_scale + radius_offset_nm)
    return registration.find_clumps_within_channel(near, probe, "t", "x", "y", "_radius", time_gap_tolerance, rowKey).drop("_radius")


@operator("SphericalHarmonicShell", "input_name", output=("output_name", "output_name_mapped"))
def _shell(df: DataFrame, max_n_mode: int = 3, max_iterations: int = 2, init_tolerance: float = 0.3, name_inside_shell: str = "inside_shell", name_distance_to_shell: str = "distance_to_shell", d_angles: float = 0.1, labels: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """labels: columns of which each value has a shell of its own."""
    found = shells.fit_shells(df, labels, degree=max_n_mode, rounds=max_iterations, tolerance=init_tolerance)
    placed = shells.shell_coordinates(df, found, labels).select(*df.columns, F.col("inside_shell").alias(name_inside_shell))
    return found, shells.distance_to_shell(placed, found, labels, step=d_angles).withColumnRenamed("distance_to_shell", name_distance_to_shell)


@operator("AddSphericalHarmonicShellMappedCoords", "input_localizations", "input_shell", output="output_mapped")
def _shell_mapped(df: DataFrame, found: DataFrame, labels: list[str] = ()) -> DataFrame:
    return shells.shell_coordinates(df, found, labels).drop("shell_radius", "inside_shell", "radial_distance")


@operator("SHShellRadiusDensityEstimate", "input_shell", output="output")
def _shell_density(found: DataFrame, r_bin_spacing: float = 0.05, sampling_nm: float = 75.0, labels: list[str] = ()) -> DataFrame:
    return shells.radius_density(found, labels, sampling_nm, r_bin_spacing)


@operator("VectorfieldNorm", "inputX", "inputY")
def _field_norm(a: DataFrame, b: DataFrame) -> DataFrame:
    return images.combine(a, b, _keys(a, b), F.hypot)


@operator("VectorfieldAngle", "inputX", "inputY", output="outputTheta")
def _field_angle(a: DataFrame, b: DataFrame) -> DataFrame:
    return images.combine(a, b, _keys(a, b), lambda x, y: F.atan2(y, x))


@operator("FitPoints", "inputImage", "inputPositions")
def _fit_points(df: DataFrame, points: DataFrame, roiHalfSize: int = 7, sigma: float = 1.2) -> DataFrame:
    return localise.localise(df, _keys(df, points), roiHalfSize, sigma, points=points)


@operator("MultifitBlobs", "inputImage")
def _multifit(df: DataFrame, blobSigma: float = 1.2, threshold: float = 5.0) -> DataFrame:
    """blobSigma in pixels; threshold in units of the noise."""
    return emitters.fit_regions(df, [k for k in FRAME_KEYS if k in df.columns], blobSigma, threshold)


@operator("FitDumbells", "inputImage", "inputPositions")
def _dumbbells(df: DataFrame, points: DataFrame, roiHalfSize: int = 7, sigma: float = 1.2, pointKey: str = "point_id") -> DataFrame:
    return emitters.fit_dumbbells(df, points, _keys(df, points), roiHalfSize, sigma, pointKey)


@operator("DetectPoints2D", "input_name", output="output_name")
def _detect(df: DataFrame, threshold: float = 1.0, debounce_radius: int = 4, snr_threshold: bool = True, multithreshold: bool = False, edge_mask_width: int = 5, filter_radius_lowpass: float = 1.0, filter_radius_highpass: float = 3.0, blur_radius: float = 1.5) -> DataFrame:
    keys = [k for k in FRAME_KEYS if k in df.columns]
    return localise.detect_points(df, keys, threshold, snr_threshold, multithreshold, filter_radius_lowpass, filter_radius_highpass, debounce_radius, edge_mask_width, blur_radius)


@operator("FlatfiledAndDarkCorrect", "inputImage", "inputCameras")
def _camera(df: DataFrame, cameras: DataFrame) -> DataFrame:
    return camera.correct(df, cameras)


@operator("PointFeaturesPairwiseDist", "inputLocalisations")
def _features(df: DataFrame, binWidth: float = 100.0, numBins: int = 20, threeD: bool = True, normaliseRelativeDensity: bool = False, rowKey: str = "row_id") -> DataFrame:
    return spatial.distance_features(df, ("x", "y", "z") if threeD else ("x", "y"), numBins, binWidth, rowKey, normaliseRelativeDensity)


@operator("ImageCumulativeHistogram", "inputImage")
def _cumulative(df: DataFrame) -> DataFrame:
    return aggregates.cumulative_histogram(df.select(F.explode("pixels").alias("value")), "value")


@operator("ExtractTracks", "inputMeasurements", output="outputTracks")
def _tracks(df: DataFrame, clump: str = "clumpIndex", columns: list[str] = ("x", "y")) -> DataFrame:
    return windows.tracks(df, clump, "t", columns)


@operator("BackgroundSubtractionMovingAverage", "input_name", output="output_name")
def _background(df: DataFrame, window: list[int] = (-32, 0, 1), seriesKey: str = "series") -> DataFrame:
    return images.background_subtract(df, seriesKey, "t", window[0], window[1])


class Recipe:
    """Steps in any order of a YAML list of {operator: parameters}. Names are checked when the recipe is made."""

    def __init__(self, steps: list[Mapping[str, Mapping[str, Any]]]):
        self.steps: list[tuple[Operator, dict[str, Any], tuple[str | None, ...]]] = []
        outputs: set[str] = set()
        for step in steps:
            (name, given), = step.items()
            found = OPERATORS.get(LEGACY.get(name, name).rsplit(".", 1)[-1])
            if not found:
                raise KeyError(f"no operator {name}")
            params = dict(given)
            names = (found.output,) if isinstance(found.output, str) else found.output
            outs = tuple(params.pop(n) if len(names) == 1 else params.pop(n, None) for n in names)
            if not any(outs):
                raise KeyError(f"{name} needs one of {', '.join(names)}")
            for out in filter(None, outs):
                if out in outputs:
                    raise ValueError(f"two steps write {out}")
                outputs.add(out)
            self.steps.append((found, params, outs))

    @classmethod
    def from_yaml(cls, text: str) -> Recipe:
        return cls(yaml.safe_load(text))

    def execute(self, namespace: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The namespace with all outputs. Plans are composed; nothing runs."""
        known = dict(namespace)
        waiting = list(self.steps)
        while waiting:
            wanted = lambda s: [s[1].get(i) for i in s[0].inputs if i not in s[0].optional or s[1].get(i)]
            ready = [s for s in waiting if all(i in known for i in wanted(s))]
            if not ready:
                raise KeyError(f"no table for {sorted({i for s in waiting for i in wanted(s)} - set(known), key=str)}")
            for op, params, outs in ready:
                rest = {k: v for k, v in params.items() if k not in op.inputs}
                found = op.run(*(known[params[i]] if params.get(i) else None for i in op.inputs), **rest)
                found = found if isinstance(found, tuple) else (found,)
                known |= {out: df for out, df in zip(outs, found, strict=True) if out}
            waiting = [s for s in waiting if s not in ready]
        return known


def run_files(spark: SparkSession, recipe: Recipe, inputs: Mapping[str, str], output: str, target: str) -> None:
    """A recipe over input files (globs give one plan for all files), one output written once."""
    write_table(recipe.execute({name: read_table(spark, uri) for name, uri in inputs.items()})[output], target)
