"""The upload stream, job states, conversation memory and event windows."""
