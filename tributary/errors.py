"""What can go wrong, each with the status it is reported as."""


class Refusal(ValueError):
    """An operation that is refused; `status` says how."""

    status = "INVALID_INPUT"

    def __init__(self, message: str, status: str | None = None):
        super().__init__(message)
        if status:
            self.status = status


class Unsupported(Refusal):
    status = "UNSUPPORTED"


class LimitExceeded(Refusal):
    status = "LIMIT_EXCEEDED"


class Incompatible(Refusal):
    status = "DATA_INCOMPATIBLE"


class Conflicted(Refusal):
    status = "CONFLICT"


class Incomplete(Refusal):
    status = "INCOMPLETE"


#: The exit code of each status.
EXITS = {
    "READY_FOR_REVIEW": 0, "APPROVED": 0, "VERIFIED": 0, "INSPECTED": 0, "OUTPUT_HASHES_MATCH": 0,
    "NEEDS_DECISIONS": 1, "DATA_INCOMPATIBLE": 1, "CONFLICT": 1,
    "UNSUPPORTED": 2, "INVALID_INPUT": 2,
    "LIMIT_EXCEEDED": 3, "INCOMPLETE": 3, "CANCELLED": 3,
    "ERROR": 4,
}

#: Spark error conditions by the status they mean.
CONDITIONS = {
    "CAST_OVERFLOW": "DATA_INCOMPATIBLE",
    "CAST_INVALID_INPUT": "DATA_INCOMPATIBLE",
    "ARITHMETIC_OVERFLOW": "DATA_INCOMPATIBLE",
    "NUMERIC_VALUE_OUT_OF_RANGE": "DATA_INCOMPATIBLE",
    "PATH_NOT_FOUND": "INCOMPLETE",
    "FILE_NOT_EXIST": "INCOMPLETE",
    "PATH_ALREADY_EXISTS": "CONFLICT",
    "PARQUET_TYPE_ILLEGAL": "UNSUPPORTED",
    "UNSUPPORTED_DATA_TYPE_FOR_DATASOURCE": "UNSUPPORTED",
}


def status_of(error: BaseException) -> str:
    """The status of an exception: its own, its task's, its Spark condition's, or its system error's."""
    import errno

    if isinstance(error, Refusal):
        return error.status
    if isinstance(error, KeyboardInterrupt):
        return "CANCELLED"
    if isinstance(error, FileNotFoundError):
        return "INCOMPLETE"
    if isinstance(error, FileExistsError):
        return "CONFLICT"
    if isinstance(error, MemoryError) or (isinstance(error, OSError) and error.errno in (errno.ENOMEM, errno.ENOSPC, errno.EDQUOT)):
        return "LIMIT_EXCEEDED"
    condition = getattr(error, "getCondition", lambda: None)()
    text = f"{condition or ''} {error}"
    for kind in Refusal.__subclasses__():  # a refusal in a task arrives as text
        if f"{kind.__module__}.{kind.__name__}:" in text:
            return kind.status
    for name, status in CONDITIONS.items():
        if name in text:
            return status
    return "ERROR"
