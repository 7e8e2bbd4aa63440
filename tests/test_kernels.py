import numpy as np
import pytest

from photonflow.operators import images, kernels


def test_neighbourhoods_and_morphology():
    image = np.zeros((7, 7))
    image[3, 3] = 1
    assert kernels.neighbourhood(np.max)(image).sum() == 9 and kernels.neighbourhood(np.mean)(image)[2, 2] == pytest.approx(1 / 9)
    assert kernels.despeckle()(image).max() == 0 or image.max() == 1
    assert kernels.binary_morphology(True, 1)(image).sum() == 5 and kernels.binary_morphology(False, 1)(image).sum() == 0
    assert np.array_equal(kernels.white_tophat(1)(image), image)
    ring = np.zeros((7, 7))
    ring[1:6, 1:6] = 1
    ring[3, 3] = 0
    assert kernels.fill_holes(ring).sum() == 25
    assert kernels.mask_edges(2)(np.ones((7, 7))).sum() == 9


def test_labels_and_thresholds():
    image = np.zeros((6, 8))
    image[0, 0:2] = image[4, 3:7] = image[2, 7] = 1
    assert sorted(np.unique(images.label(image))) == [0, 1, 2, 3]
    assert sorted(np.unique(kernels.label_regions(2)(image))) == [0, 1]
    assert kernels.largest_label(images.label(image)).sum() == 4
    two = np.concatenate([np.full(50, 1.0), np.full(50, 9.0)]) + np.linspace(-0.5, 0.5, 100)
    assert 1 <= kernels.otsu_level(two) < 9 and 1 <= kernels.isodata_level(two) < 9
    assert kernels.threshold_by(kernels.otsu_level)(two.reshape(10, 10)).sum() == 50
    assert kernels.local_maxima(0.5, 2)(image)[2, 7] == 1


def test_distance_registration_deconvolution():
    image = np.zeros((9, 9))
    image[4, 4] = 1
    d = kernels.distance_transform(image)
    assert d[4, 4] == -1 and d[4, 7] == 3 and d[1, 0] == 5
    rng = np.random.default_rng(1)
    spots = images.gaussian(1.5)((rng.random((32, 32)) > 0.98).astype(float))
    y, x = kernels.registration_shift(spots, np.roll(spots, (3, -2), (0, 1)))
    assert abs(y - 3) < 0.6 and abs(x + 2) < 0.6
    psf = images.gaussian(1.0)(np.pad([[1.0]], 4))
    blurred = np.fft.irfft2(np.fft.rfft2(image) * np.fft.rfft2(np.roll(psf, (-4, -4), (0, 1))), s=(9, 9))
    assert kernels.richardson_lucy(psf, 30)(np.maximum(blurred, 0))[4, 4] > 2 * blurred[4, 4]
    assert np.allclose(kernels.fourier_ring_correlation(spots, spots), 1)


def test_rois_and_channels(spark):
    image = np.arange(81.0).reshape(9, 9)
    frames = spark.createDataFrame([(1, 9, 9, image.ravel().tolist())], "t int, height int, width int, pixels array<double>")
    points = spark.createDataFrame([(1, 4.2, 5.0), (1, 0.0, 4.0)], "t int, x double, y double")
    roi, = images.extract_rois(frames, points, ["t"], 2).collect()
    assert np.array_equal(np.reshape(roi.roi, (5, 5)), image[3:8, 2:7]) and (roi.x, roi.y) == (pytest.approx(2.2), 2)
    ids = frames.withColumn("pixels", images.F.transform("pixels", lambda p: (p % 3).cast("int")))
    masks = images.labels_to_channels(ids).collect()
    assert sorted(m.channel for m in masks) == [1, 2] and all(sum(m.pixels) == 27 for m in masks)
    assert images.rotate180(frames).first().pixels[0] == 80
