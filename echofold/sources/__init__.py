"""Sources: file digests, frame hashes and audio fingerprints of media files, hashes of image files."""
