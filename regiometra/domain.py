"""Status domain, cut points and advice texts, and the tables built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# These must equal the published ones for results to agree.
STATUS_ORDER = ["SANGAT TERTINGGAL", "TERTINGGAL", "BERKEMBANG", "MAJU", "MANDIRI"]
LAGGING = ["TERTINGGAL", "SANGAT TERTINGGAL"]
TOP_STATUS = "MANDIRI"
CUT_POINTS = [0.4907, 0.5989, 0.7072, 0.8155]
# (status, lower bound included, upper bound excluded, label)
UPGRADE_BANDS = [
    ("SANGAT TERTINGGAL", 0.4707, 0.4907, "Potensi ke TERTINGGAL"),
    ("TERTINGGAL", 0.5789, 0.5989, "Potensi ke BERKEMBANG"),
    ("BERKEMBANG", 0.6872, 0.7072, "Potensi ke MAJU"),
    ("MAJU", 0.7955, 0.8155, "Potensi ke MANDIRI"),
]
NO_BAND = "Biasa"
# Order decides ties between equally low dimensions.
DIMENSIONS = ["Sosial", "Ekonomi", "Lingkungan"]
ADVICE = [
    ("Sosial", 1, "Perkuat akses pendidikan dasar dan pelatihan masyarakat"),
    ("Sosial", 2, "Tingkatkan layanan kesehatan primer dan posyandu"),
    ("Ekonomi", 1, "Dorong pengembangan UMKM desa dan akses pembiayaan"),
    ("Ekonomi", 2, "Perluas akses pasar dan digitalisasi ekonomi lokal"),
    ("Lingkungan", 1, "Perbaiki sanitasi, air bersih, dan pengelolaan limbah"),
    ("Lingkungan", 2, "Perkuat mitigasi risiko lingkungan dan ketahanan bencana"),
]
NO_SPECIFIC_TEXT = "Tidak ada rekomendasi spesifik"
NO_RECORD_TEXT = "Tidak ada data rekomendasi"
PLACEHOLDER_TEXTS = ["", "-"]
CLUSTER_PREFIX = "Klaster "
BALANCE_TOLERANCE = 0.1
IDENTITY_COLUMNS = [
    "KODE PROV", "NAMA PROVINSI", "KODE KAB", "NAMA KABUPATEN",
    "KODE KEC", "NAMA KECAMATAN", "KODE DESA", "NAMA DESA",
]
JUNK_COLUMNS = ["Keterangan", "Unnamed: 14"]
NAME_PATCHES = {1101012003: "UJONG PADANG"}
# End of fixed values.


@dataclass(frozen=True)
class Columns:
    """Names of the columns the plans work on; override any to bind other tables."""

    unit: str = "KODE_DESA"
    unit_name: str = "NAMA_DESA"
    region: str = "NAMA_PROVINSI"
    district: str = "NAMA_KABUPATEN"
    subdistrict: str = "NAMA_KECAMATAN"
    social: str = "IKS_2024"
    economic: str = "IKE_2024"
    environment: str = "IKL_2024"
    score: str = "NILAI_IDM_2024"
    status: str = "STATUS_IDM_2024"
    child_unit: str = "KODE DESA"
    child_text: str = "KETERANGAN"
    child_value: str = "NILAI"
    child_target: str = "TARGET IDM 2025"
    child_count: str = "jumlah_rekomendasi"
    child_total: str = "total_nilai_rekomendasi"
    child_joined: str = "keterangan_gabungan"
    target: str = "target_idm_2025"
    matched: str = "has_rekomendasi"
    weakest: str = "dimensi_terendah"
    gap_economic: str = "gap_iks_ike"
    gap_environment: str = "gap_iks_ikl"
    intensity: str = "intensitas_rekomendasi"
    cluster: str = "KLASTER"
    cluster_label: str = "KLASTER_LABEL"

    @property
    def indices(self) -> list[str]:
        return [self.social, self.economic, self.environment]

    @property
    def measures(self) -> list[str]:
        return [*self.indices, self.score]

    @property
    def numeric(self) -> list[str]:
        return [*self.measures, self.child_count, self.child_total,
                self.gap_economic, self.gap_environment, self.intensity]

    @property
    def correlated(self) -> list[str]:
        return [*self.measures, self.child_count, self.gap_economic, self.gap_environment]

    @property
    def model_numeric(self) -> list[str]:
        return [*self.indices, self.child_count, self.child_total,
                self.gap_economic, self.gap_environment, self.intensity]

    @property
    def dimension_of(self) -> dict[str, str]:
        """Index column -> dimension name, in tie order."""
        return dict(zip(self.indices, DIMENSIONS))


def status_table(spark: SparkSession, statuses: list[str] = STATUS_ORDER) -> DataFrame:
    """(status, ordinal), one row per status of the domain."""
    return spark.createDataFrame(
        [(s, i) for i, s in enumerate(statuses)], "status string, ordinal int")


def advice_table(spark: SparkSession, advice: list[tuple[str, int, str]] = ADVICE) -> DataFrame:
    return spark.createDataFrame(advice, "dimension string, seq int, advice string")
