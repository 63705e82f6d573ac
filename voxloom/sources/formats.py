"""File format registry: which header and data file a name stands for."""

from __future__ import annotations

from dataclasses import dataclass

from .nifti import filesystem


@dataclass(frozen=True)
class FileFormat:
    name: str
    header: str
    data: str

    def strip_extension(self, path: str) -> str:
        for e in sorted({self.header, self.data}, key=len, reverse=True):
            if path.endswith("." + e):
                return path[: -len(e) - 1]
        raise ValueError(f"{path} is no {self.name} file")

    def header_file_matches(self, path: str) -> bool:
        return path.endswith("." + self.header)

    def data_file_matches(self, path: str) -> bool:
        return path.endswith("." + self.data)

    def header_file(self, path: str) -> str:
        return f"{self.strip_extension(path)}.{self.header}"

    def data_file(self, path: str) -> str:
        return f"{self.strip_extension(path)}.{self.data}"

    def file_matches(self, path: str) -> bool:
        """The name fits, and both files exist."""
        if not (self.header_file_matches(path) or self.data_file_matches(path)):
            return False
        return all(exists(p) for p in (self.header_file(path), self.data_file(path)))


def exists(path: str) -> bool:
    from pyarrow import fs

    store, name = filesystem(path)
    return store.get_file_info(name).type == fs.FileType.File


NIFTI, NIFTI_GZ = FileFormat("NIFTI", "nii", "nii"), FileFormat("NIFTI_GZ", "nii.gz", "nii.gz")
PAIR, PAIR_GZ = FileFormat("NIFTI_PAIR", "hdr", "img"), FileFormat("NIFTI_PAIR_GZ", "hdr.gz", "img.gz")
AFNI, AFNI_GZ = FileFormat("AFNI", "HEAD", "BRIK"), FileFormat("AFNI_GZ", "HEAD", "BRIK.gz")
FORMATS = (NIFTI, NIFTI_GZ, PAIR, PAIR_GZ, AFNI, AFNI_GZ)


def find_format(path: str) -> FileFormat | None:
    return next((f for f in FORMATS if f.file_matches(path)), None)
