"""Kernels on one packed two-dimensional field."""

from __future__ import annotations

import numpy as np

#: weight of the diagonal neighbours by name of the stencil
STENCILS = {"OP": 0.5, "5pt": 0.0, "PK": 1 / 3}


def low_pass(z: np.ndarray, dx: float, dy: float, scale: float = 5000.0) -> np.ndarray:
    """Gaussian low-pass with cut-off wavenumber 2 pi / scale, demeaned."""
    ky, kx = (2 * np.pi * np.fft.fftfreq(n, d) for n, d in zip(z.shape, (dy, dx), strict=True))
    gain = np.exp(-(ky[:, None] ** 2 + kx[None, :] ** 2) / (2 * np.pi / scale) ** 2)
    out = np.fft.ifft2(np.fft.fft2(z) * gain).real
    return out - out.mean()


def taper(inside: np.ndarray, steps: int, stencil: str = "OP", dt: float = 0.5, scale: float = 1.0) -> np.ndarray:
    """A mask diffused outwards with a nine-point stencil, its inside held at one; zeros lie outside the field."""
    gamma, p = STENCILS[stencil], inside.astype(float)
    for _ in range(steps):
        q = np.pad(p, 1)
        cross = q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * p
        diagonal = (q[:-2, :-2] + q[:-2, 2:] + q[2:, :-2] + q[2:, 2:] - 4 * p) / 2
        p = p + dt * scale * ((1 - gamma) * cross + gamma * diagonal)
        p[inside] = 1
    return p


def diffused_noise(shape: tuple[int, int], seed: int, steps: int = 1000, dt: float = 0.1) -> np.ndarray:
    """Noise smoothed by periodic diffusion and stretched to [-1, 1]."""
    z = np.random.default_rng(seed).random(shape)
    for _ in range(steps):
        z = z + dt * (np.roll(z, 1, 0) + np.roll(z, -1, 0) + np.roll(z, 1, 1) + np.roll(z, -1, 1) - 4 * z)
    return 2 * (z - z.min()) / max(float(np.ptp(z)), 1e-300) - 1


def power_law(n: int, beta: float, seed: int) -> np.ndarray:
    """A field with random phases whose power falls as wavenumber ** -beta."""
    rng = np.random.default_rng(seed)
    k = np.hypot(np.fft.fftfreq(n)[:, None], np.fft.fftfreq(n)[None, :])
    k[0, 0] = np.inf
    return np.fft.ifft2(k ** (-beta / 2) * np.exp(2j * np.pi * rng.random((n, n)))).real


def spectrum(z: np.ndarray) -> np.ndarray:
    """Amplitudes of the real two-dimensional transform over half the number of nodes, rows in ascending wavenumber."""
    return np.abs(np.fft.fftshift(np.fft.rfft2(z) / (z.size / 2), axes=0))
