"""Part of siftrock."""
