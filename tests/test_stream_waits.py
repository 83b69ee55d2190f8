"""A stream that ends by itself is waited for, unless a limit is given."""

import pytest

from ledgerlake.streaming import ingest as IN


class Slow:
    """A query that takes an hour."""

    isActive = True

    def awaitTermination(self, timeout=None):
        self.isActive = timeout is not None and timeout < 3600

    def exception(self):
        return None

    def stop(self):
        self.isActive = False


def test_no_limit_by_default():
    IN.run_to_completion(Slow)
    with pytest.raises(TimeoutError):
        IN.run_to_completion(Slow, 600)
