"""Readers and writers: folders of files, parser runs, stored artefacts, exports."""
