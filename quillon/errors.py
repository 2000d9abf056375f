"""What a caller may catch: broken contracts of folders, generations, suites and sessions. What goes wrong with a row is a column."""


class ContractError(ValueError):
    """A contract that this package states and checks doesn't hold."""


class SharedFolderMissing(ContractError):
    """The session names no folder that all machines share."""


class SuiteInvalid(ContractError):
    """An evaluation suite has no queries, or isn't what its format says."""


class CommandUnknown(ContractError):
    """A session was given a command or a value that it doesn't know."""


class CommitConflict(ContractError):
    """Another writer has put the log entry that this one wanted; read the new state and decide again."""


class GenerationUnavailable(ContractError):
    """A generation, run or snapshot that was asked for was never written, is given up, or isn't the active one."""
