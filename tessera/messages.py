"""The wording of the tools' answers."""

#: What users of the tools read.
INVALID_SPLITTER = "Invalid splitter type '{splitter}'. Must be 'ast' or 'langchain'."
ALREADY_INDEXING = "Codebase '{path}' is already being indexed in the background. Please wait for completion."
RESOLVED = "\nNote: Input path '{given}' was resolved to absolute path '{path}'"
CUSTOM_EXTENSIONS = "\nUsing {n} custom extensions: {listed}"
CUSTOM_PATTERNS = "\nUsing {n} custom ignore patterns: {listed}"
STARTED = (
    "Started background indexing for codebase '{path}' using {splitter} splitter.{notes}\n\nIndexing is running in the background. "
    "You can search the codebase while indexing is in progress, but results may be incomplete until indexing completes."
)
NOT_INDEXED = "Codebase '{path}' is not indexed. Please index it first using the analyze_code tool."
INVALID_EXTENSION = "Invalid file extension in extensionFilter: '{ext}'. Use proper extensions like '.ts', '.py'."
NO_RESULTS = "No results found for query: \"{query}\" in codebase '{path}'"
NO_RESULTS_YET = (
    "\n\nNote: This codebase is still being indexed. Try searching again after indexing completes, or the query may not match any indexed content."
)
FOUND = "Found {n} results for query: \"{query}\" in codebase '{path}'{busy}\n\n{body}{tip}"
BUSY = (
    "\n**Indexing in Progress**: This codebase is currently being indexed in the background. Search results may be incomplete until indexing completes."
)
TIP = "\n\n**Tip**: This codebase is still being indexed. More results may become available as indexing progresses."
NOTHING_INDEXED = "No codebases are currently indexed or being indexed."
NOT_KNOWN = "Codebase '{path}' is not indexed or being indexed."
CLEARED = "Successfully cleared codebase '{path}'"
REMAINING = "\n{indexed} other indexed codebase(s) and {indexing} indexing codebase(s) remain"
STATUS_UNKNOWN = "Codebase '{path}' is not indexed. Please use the analyze_code tool to index it first."
STATUS_INDEXED = "Codebase '{path}' is fully indexed and ready for search.\nStatistics: {files} files, {chunks} chunks\nStatus: {status}\nLast updated: {when}"
STATUS_INDEXING = "Codebase '{path}' is currently being indexed. Progress: {done:.1f}%{hint}\nLast updated: {when}"
HINT_SCANNING = " (Preparing and scanning files...)"
HINT_EMBEDDING = " (Processing files and generating embeddings...)"
STATUS_FAILED = "Codebase '{path}' indexing failed.\nError: {error}{reached}\nFailed at: {when}\nYou can retry indexing by running the analyze_code tool again."
FAILED_PROGRESS = "\nFailed at: {at:.1f}% progress"
TRUNCATED = "...\n[Content truncated]"
RESULT = "{index}. Code snippet ({language}) [{codebase}]\n   Location: {location}\n   Rank: {index}\n   Context: \n```{language}\n{snippet}\n```\n"
