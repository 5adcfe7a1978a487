"""Refusals, one exception for each rule a caller can act on."""


class IndexError_(Exception):
    """Base of all refusals."""


class DimensionMismatch(IndexError_):
    def __init__(self, want: int, got: int) -> None:
        super().__init__(f"wanted {want} dimensions, got {got}")
        self.want, self.got = want, got


class TooManyDimensions(IndexError_):
    def __init__(self, dims: int, most: int) -> None:
        super().__init__(f"{dims} dimensions; at most {most} fit a row")


class DocIdTooLarge(IndexError_):
    def __init__(self, doc_id: int, most: int) -> None:
        super().__init__(f"doc id {doc_id} is outside [0, {most}]")


class ReservedDocId(IndexError_):
    pass


class AttrTermTooLarge(IndexError_):
    def __init__(self, term: int, most: int) -> None:
        super().__init__(f"term {term} is outside [0, {most}]")


class AlreadyExists(IndexError_):
    pass


class KeyspaceOccupied(IndexError_):
    pass


class CompactionPending(IndexError_):
    pass


class CompactionMismatch(IndexError_):
    pass


class CorruptMeta(IndexError_):
    pass


class UnsupportedLayout(IndexError_):
    pass


class BinarySearchOnResidualIndex(IndexError_):
    pass


class SnapshotExpired(IndexError_):
    pass


class InvalidArgument(IndexError_):
    pass


class WriterStopped(IndexError_):
    """A publish had an unknown outcome; the index must be opened again."""


class CodecError(IndexError_):
    pass


class InvalidModel(CodecError):
    pass


class InvalidVector(CodecError):
    pass


class ScoreOverflow(CodecError):
    pass


class CorruptModel(CodecError):
    pass


class ModelMismatch(CodecError):
    pass


class NoModelIdentity(CodecError):
    pass


#: Service status of each refusal; anything else is "internal".
STATUS = {
    SnapshotExpired: "aborted",
    DimensionMismatch: "invalid_argument",
    ReservedDocId: "invalid_argument",
    AttrTermTooLarge: "invalid_argument",
    InvalidArgument: "invalid_argument",
    AlreadyExists: "already_exists",
    ModelMismatch: "failed_precondition",
    NoModelIdentity: "failed_precondition",
    BinarySearchOnResidualIndex: "failed_precondition",
    CorruptMeta: "data_loss",
    CorruptModel: "data_loss",
}


def status(error: Exception) -> str:
    return next((s for kind, s in STATUS.items() if isinstance(error, kind)), "internal")
