import math

import pytest

from tesselith import config, registry


@pytest.mark.parametrize(
    "make",
    [
        lambda: config.StackSettings(combination="mode"),
        lambda: config.StackSettings(low=0),
        lambda: config.SelectionSettings(least_roundness=math.nan),
        lambda: config.SelectionSettings(least_roundness=2),
        lambda: config.SelectionSettings(least_stars=0),
        lambda: config.SelectionSettings(percent=True),
        lambda: config.SelectionSettings(method="multi_metric"),
        lambda: config.SelectionSettings(weights={"fwhm": -1.0}),
        lambda: config.SessionSettings(gap_minutes=math.inf),
        lambda: config.HdrSettings(noise_floor=0),
    ],
)
def test_wrong_settings_raise(make):
    with pytest.raises(ValueError):
        make()


def test_registry():
    assert registry.names("align.warp") == ["bilinear", "nearest"]
    assert callable(registry.engine("stack.reducer", "sigma"))
    with pytest.raises(KeyError):
        registry.engine("stack.reducer", "none such")
