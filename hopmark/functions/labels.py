"""Fixed values of the classifier, and measurement configurations."""

from __future__ import annotations

from dataclasses import dataclass

#: The labels in priority order; the last is an outcome of merging only.
LABELS = ("REFLECTION", "CONSTANT", "PER_DESTINATION", "PER_CONNECTION", "SINGLE", "PER_BUCKET", "MULTI", "RANDOM", "UNCLASSIFIED", "NOT_ENOUGH_SAMPLES")
CLASSIFIER_LABELS = LABELS[:9]
#: Identifiers are 16 bits; the largest step of a counter; the gap between clusters; most clusters; the calibrated score.
MODULUS = 65536
MAX_INC = 21845
CLUSTER_GAP = 800
MAX_CLUSTERS = 16
TAU = 0.000016313656391956604
BINS, LEGACY_BINS = 16, 4
#: The identifiers that the synthetic requests carry.
REQUEST_IP_IDS = (18933, 18932, 3717, 3718, 3719)


@dataclass(frozen=True)
class Config:
    """connections x requests probes a sequence, one after the other within a round; the identifiers of the requests repeat."""

    connections: int = 4
    requests: int = 4
    request_ip_ids: tuple[int, ...] = REQUEST_IP_IDS

    @property
    def length(self) -> int:
        return self.connections * self.requests

    @property
    def pattern(self) -> list[int]:
        ids = self.request_ip_ids
        return [ids[i % len(ids)] for i in range(self.length)]


BASE, MASS = Config(4, 4), Config(4, 25)
