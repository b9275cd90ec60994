"""The registered bootstrap draws the survey's 1,000 resamples."""

from tesserae import registry
from tesserae.plans import calibration


def test_a_thousand_resamples(spark, small, monkeypatch):
    asked, real = [], calibration.K.bootstrap

    def bootstrap(rows, values, by, samples=1000, **more):
        asked.append(samples)
        return real(rows, values, by, samples=samples, **more)

    monkeypatch.setattr(calibration.K, "bootstrap", bootstrap)
    assert registry.QUERIES["bootstrap_ci"](spark, small).count() > 0
    assert asked == [1000]
