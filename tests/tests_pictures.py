import numpy as np


def synthetic(w: int, h: int) -> np.ndarray:
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    return np.stack([(17 * x ^ 31 * y) & 255, (43 * x + 13 * y) & 255, (7 * x ^ 11 * y) & 255], -1)
