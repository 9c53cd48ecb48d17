"""Readers and writers of image files and blobs."""
